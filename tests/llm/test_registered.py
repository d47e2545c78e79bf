"""The registered queries over the whole small tables, against brute force or their laws."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from corpusweave.llm.queries import LLM_QUERIES, vocabulary
from corpusweave.llm.sql import LLM_ORACLES
from pyspark.sql import functions as F

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"


def given(table, columns, sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{table}.parquet'").fetchall()


def run(spark, n, sf=SF):
    name = next(q for q in LLM_QUERIES if q.startswith(f"op{n}_"))
    df = LLM_QUERIES[name](spark, sf)
    return {f.name: f.dataType.simpleString() for f in df.schema}, df.collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_op1_recall(spark, sf):
    kinds, rows = run(spark, 1, f"{DATA}/{sf}")
    assert kinds == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = given("embeddings", "vec_id, embedding", f"{DATA}/{sf}")
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    found = defaultdict(dict)
    for r in rows:
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, far))
        best = [i for i in ids[order].tolist() if i != q][:10]
        hits += len({i for i, _ in got.values()} & set(best))
        assert sorted(got) == list(range(1, 11))
        assert all(abs(far[ids == i][0] - s) < 1e-12 for i, s in got.values())
        assert [p for _, p in sorted(got.items())] == sorted(got.values(), key=lambda p: (p[1], p[0]))
    assert hits >= 0.9 * 10 * len(found)


def test_op2_pieces(spark):
    kinds, rows = run(spark, 2)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert all(kinds[n] == "bigint" for n in names)
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    whole = {i: [*encode.encode(t or "", add_special_tokens=False).ids, 2] for i, t in given("documents", "doc_id, text")}
    ends, used = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(whole[r.doc_id])
        part = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        ends[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert dict(ends) == {i: len(t) for i, t in whole.items()}
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(n for _, n in parts) <= 4096
    assert len(used) <= 1.1 * sum(map(len, whole.values())) / 4096 + 1


def test_op3_links(spark):
    from test_pages_and_vectors import plain_links

    kinds, rows = run(spark, 3)
    assert kinds == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    want = plain_links(given("embeddings", "vec_id, embedding"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_op5_passages(spark):
    from test_text_operators import plain_repeats

    kinds, rows = run(spark, 5)
    assert list(kinds.values())[:5] == ["bigint"] * 4 + ["string"]
    docs = given("documents", "doc_id, text")
    want = dict(zip([i for i, _ in docs], plain_repeats([t for _, t in docs])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("n", [6, 11])
def test_with_sql(spark, n):
    _, rows = run(spark, n)
    name = next(q for q in LLM_QUERIES if q.startswith(f"op{n}_"))
    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(LLM_ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(result.fetchall(), key=repr)


def test_op7_scores(spark):
    kinds, rows = run(spark, 7, f"{DATA}/sf0.01")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = dict(given("labels", "doc_id, toxic", f"{DATA}/sf0.01"))
    assert Counter(r.doc_id for r in rows) == Counter(i for i, in given("documents", "doc_id", f"{DATA}/sf0.01"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    clean, toxic = [p for t, p in held if not t], [p for t, p in held if t]
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.6 * len(toxic) and toxic


def test_op8_laws(spark):
    kinds, rows = run(spark, 8)
    assert (kinds["size"], kinds["text_crc32"], kinds["shard"], kinds["slot"]) == ("bigint", "bigint", "int", "bigint")
    docs = given("documents", "doc_id, text")
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(40)) <= 1
    assert sorted(map(tuple, run(spark, 8)[1])) == sorted(map(tuple, rows))


def test_op9_texts(spark):
    kinds, rows = run(spark, 9)
    assert kinds == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert Counter((r.page_id, r.url) for r in rows) == Counter(given("pages", "page_id, url"))
    assert all(r.n_chars == len(r.text) for r in rows) and all("<" not in r.text for r in rows)
    html_ = dict(given("pages", "page_id, html"))
    for r in rows:
        # the given pages have one article; its paragraphs, in order, are the text
        body = re.search(r"(?s)<h1>.*?</h1>", html_[r.page_id])
        title = re.sub(r"<[^>]+>", "", body.group()) if body else ""
        assert not title or r.text.startswith(title.replace("&amp;", "&").strip()[:10])


def test_op10_components(spark):
    from test_text_operators import sets

    kinds, rows = run(spark, 10)
    assert kinds == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    docs = [(i, sets(t, 4)) for i, t in given("documents", "doc_id, text")]
    top = {i: i for i, _ in docs}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, x) in enumerate(docs):
        for j, y in docs[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(x or ()), root(i)) for i, x in docs}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_pipeline_run(spark):
    """The stages one after the other, each judged on what the one before kept."""
    sf = f"{DATA}/sf0.01"
    ends = defaultdict(int)
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends[r.doc_id]
        ends[r.doc_id] += r.length
    texts = dict(given("documents", "doc_id, text", sf))
    labels = dict(given("labels", "doc_id, toxic", sf))
    kept = [texts[i] for i in ends]
    assert len(kept) == len(set(kept)) and len(kept) > 0.8 * len(set(texts.values()))
    toxic = {i for i, t in labels.items() if t}
    assert len(toxic & set(ends)) <= 0.4 * len(toxic)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    """Empty tables, null and empty texts, repeated rows, maps, columns with names of our own."""
    text = "some plain words that nobody minds " * 5
    rows = [(1, text, 1), (1, text, 1), (2, None, 2), (3, "", 3), (None, text + "x", 4), (4, "one " * 3000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    own = {c: F.lit("mine") for c in ("node", "_row", "row", "root", "record", "_kept", "toxicity", "is_toxic", "spans", "p", "length", "a.b")}
    docs = docs.select("*", *[v.alias(c) for c, v in own.items()], F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    out = stage(spark, docs, SF)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        for r in out.collect():
            assert all(r[c] == "mine" for c in own) and r.m == {"k": 1}
    else:
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}
    assert stage(spark, docs.where("false"), SF).collect() == []
