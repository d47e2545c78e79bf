"""Packing, pieces, repeats, toxicity, sharding and near duplicates against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusweave.llm import near_duplicates, packing, pieces, repeats, sharding, toxicity
from corpusweave.llm.queries import vocabulary
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def cases():
    base, passage = prose(1, 300), prose(2, 70)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [base, base, near, None, "", "  \n", "x", "aa" * 700, passage + " one", "two " + passage]
    texts += [prose(s, 120) for s in range(10, 16)] + ["é" * 450, "Short Text. one, two", prose(9, 6000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, passage[:300]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1, "clash") for i, t in cases()]
    kinds = "doc_id long, text string, record string, n long, node string"
    return spark.createDataFrame(rows, kinds).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def plain_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(d, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        yield len(d), len(d) - len(rest), runs, hashlib.sha256(rest).hexdigest()


def test_repeats(docs, empty):
    rows = repeats.without_repeats(docs).collect()
    want = sorted(zip([str(i) for i, _ in cases()], plain_repeats([t for _, t in cases()])))
    got = sorted((str(r.record.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)
    assert got == want
    assert {r.record.node for r in rows} == {"clash"}
    assert repeats.without_repeats(empty).count() == 0


def passages():
    """Texts that share passages of 51 to 65 words, most of them under 400 bytes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    own = lambda: " ".join(word() for _ in range(rng.randint(5, 90)))
    shared = [" ".join(word() for _ in range(n)) for n in range(51, 66)]
    texts = [f"{own()} {s} {own()}" for s in shared for _ in range(2)]
    return shared, [*texts, own(), "ab " * 120, "", None]


@pytest.mark.parametrize("length", [120, 200, 250, 500])
def test_repeats_of_other_lengths(spark, length):
    _, texts = passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    rows = repeats.without_repeats(df, length=length).collect()
    got = {r.record.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == dict(enumerate(plain_repeats(texts, length)))


def test_pipeline_drops_passages_of_over_50_words(spark):
    shared, texts = passages()
    assert min(map(len, shared)) < 400
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_chars long")
    kept = [r.text or "" for r in corpus_pipeline.drop_repeats(spark, df, "").collect()]
    assert not [s for s in shared if any(s in k for k in kept)]


def sets(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else None


def test_near_duplicates(docs, empty):
    rows = [(i, sets(t, 4)) for i, t in cases()]
    top = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
    big = float("inf")
    least = {}
    for k, (i, x) in enumerate(rows):
        root = (top[k], k if not x else None)
        least[root] = min(least.get(root, big), big if i is None else i)
    want = []
    for k, (i, x) in enumerate(rows):
        c = least[(top[k], k if not x else None)]
        c = i if not x else None if c == big else c
        want.append((str(i), len(x or ()), str(c), i == c))
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(want)
    assert near_duplicates.near_duplicates(empty).count() == 0


def family_rows(rng, sizes, tight):
    """Members of families: sets that differ from their family's in some of 60 shingles."""
    rows = []
    for family, n in enumerate(sizes):
        base = rng.choice(1 << 40, 60, replace=False)
        for _ in range(n):
            found = base.copy()
            some = rng.choice(60, rng.integers(0, tight + 1), replace=False)
            found[some] = rng.choice(1 << 40, len(some))
            rows.append((family, len(rows), np.unique(found).tolist()))
    return rows


def linked_groups(pairs, nodes):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("tight, percent", [(3, 80), (9, 80), (20, 80), (12, 60), (2, 100)])
def test_family_links_connect_what_is_linked(spark, monkeypatch, tight, percent):
    """Tight and loose families against all pairs, over several blocks."""
    monkeypatch.setattr(near_duplicates, "FAMILY_BLOCK", 8)
    rows = family_rows(np.random.default_rng(tight), [90, 1, 40, 2], tight)
    members = spark.createDataFrame(rows, "family long, node long, found array<long>")
    sets = {n: (f, frozenset(s)) for f, n, s in rows}
    pairs = [
        (a, b) for a, (f, x) in sets.items() for b, (g, y) in sets.items()
        if a < b and f == g and 100 * len(x & y) >= percent * len(x | y) and percent < 100
    ]
    got = [(r.a, r.b) for r in near_duplicates.family_links(members, percent).collect()]
    real = {p for a, b in pairs for p in ((a, b), (b, a))}
    assert set(got) <= real
    assert linked_groups(got, sets) == linked_groups(pairs, sets)


def test_a_family_of_20_000_is_not_copied(spark):
    """Near copies of one text: all are linked to the leader, none meets the others."""
    rows = family_rows(np.random.default_rng(5), [20_000], 3)
    members = spark.createDataFrame(rows, "family long, node long, found array<long>")
    rings = near_duplicates.ringed(members, 80)
    assert {r.ring: r["count"] for r in rings.groupBy("ring").count().collect()} == {0: 20_000}
    assert near_duplicates.block_meetings(rings).count() == 0
    # with one in a hundred further off, the copies are those of the few
    off = [(0, 50_000 + k, [10**15 + i + 60 * k for i in range(12)] + rows[0][2][12:]) for k in range(200)]
    members = members.union(spark.createDataFrame(off, members.schema))
    # (200 members in 2 blocks against 158 blocks), not those of all 158 x 158 blocks
    assert near_duplicates.block_meetings(near_duplicates.ringed(members, 80)).count() < 4 * 20_200 < 20_200 * 158 / 30


def test_signature_distance_counts_symbols():
    a, b = near_duplicates._functions()
    rng = np.random.default_rng(0)
    found = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    assert (near_duplicates.signature(found, a, b) == near_duplicates.signature(found[::-1], a, b)).all()


def test_pack(docs, empty):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    tokenizer = packing._tokenizer(path)
    whole = {}
    for i, t in cases():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        whole.setdefault(i, []).append(ids)
    assert sum(r.length for r in rows) == sum(len(x) for v in whole.values() for x in v)
    sequences = {}
    for r in rows:
        assert any(x[r.start : r.start + r.length] == r.ids and len(x) == r.doc_tokens for x in whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty, path).count() == 0


def test_words_give_the_ids_of_the_text():
    path = vocabulary("word_bpe_49k.json")
    ids = packing.WordIds(path)
    texts = ["a,b.c D.., É. 's I'll, x<|endoftext|>y", " \xa0x\x85y ΑΣ. İ. ß, ３. á.", "", prose(3, 50), None, "\n\t a\rb\x0bc\x0cd \n"]
    texts += [texts[3] * 20, "  ", texts[0]]
    for some in (texts, texts[2:3], texts[4:5], [], texts[1:4]):
        data, begins = ids(pa.array(["skipped", *some], pa.string()).slice(1))
        assert len(begins) == len(some) + 1
        for text, begin, end in zip(some, begins, begins[1:]):
            want = packing._tokenizer(path).encode(text or "", add_special_tokens=False).ids
            assert data[begin:end].tobytes() == np.array(want, "<u4").tobytes()
    assert list(packing._slices(pa.array(["aa", None, "aaa", "a" * 50, "a", ""]), 5)) == [(0, 3), (3, 4), (4, 6)]


def test_plan_uses_every_piece_and_wastes_little():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.clip(rng.gamma(2, 30, 50_000), 1, 256).astype(int), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    used, windows = {}, 0
    for fill, repeats_ in packing.plan_windows(histogram, 256):
        assert sum(fill) <= 256
        windows += repeats_
        for k in fill:
            used[k] = used.get(k, 0) + repeats_
    assert used == histogram
    assert sum(k * n for k, n in histogram.items()) > 0.995 * 256 * windows


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(2)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain < 1e-7).all() and abs(gain @ x) < 1e-7


def test_external_shuffle(docs, empty):
    for place in (None, [F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()]):
        dealt = sharding.external_shuffle(docs, F.coalesce(F.length("text"), F.lit(0)), 4, place, 4000)
        rows = dealt.collect()
        assert sorted((str(r.record.doc_id), str(r.record.text)) for r in rows) == sorted(
            (str(i), str(t)) for i, t in cases()
        )
        slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
        assert all(v == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.external_shuffle(docs, F.lit(1), 4, None, 10)
    assert sorted(map(str, again.collect())) == sorted(
        map(str, sharding.external_shuffle(docs.repartition(7), F.lit(1), 4, None, 10).collect())
    )
    assert sharding.external_shuffle(empty, F.lit(1)).count() == 0


def full_search(model, text):
    best = {0: (0.0, 0, -1)}
    for end in range(1, len(text) + 1):
        found = []
        for at in range(max(0, end - model.longest), end):
            piece = model.best.get(text[at:end])
            if piece is None and at == end - 1:
                piece = (model.unknown, -1)
            if piece is not None:
                found.append((best[at][0] + piece[0], -at, piece[1]))
        total, at, piece = max(found, key=lambda f: f[:2])
        best[end] = (total, -at, piece)
    ids, end = [], len(text)
    while end:
        _, at, piece = best[end]
        ids = ([piece] if piece >= 0 else [model.byte_ids[b] for b in text[at:end].encode()]) + ids
        end = at
    return ids


def test_streaming_search_is_the_full_search(docs):
    model = pieces.load(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(4)
    for n in (1, 5, 70, 400, 900):
        text = "".join(rng.choice("abcdethn▁ é漢i\n") for _ in range(n))
        assert list(model.search(text)) == full_search(model, text)
    for _, t in cases():
        assert model.decode(model.encode(t)) == (t or "")
    whole = prose(5, 20)
    assert model.encode(whole).tolist() == full_search(model, pieces.SPACE + whole.replace(" ", pieces.SPACE))
    rows = pieces.encoded(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert len(rows) == len(cases()) and all(r.same for r in rows)


def test_toxicity(spark, empty):
    rng = random.Random(6)
    rows = [(i, prose(i, 60) + (" you nasty creature" if rng.random() < 0.2 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    labels = [(i, int("nasty" in t)) for i, t in rows if i % 3]
    known = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, known).collect()
    truth = {i: int("nasty" in t) for i, t in rows}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.is_toxic == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(out) == 402 and all(0 <= r.toxicity <= 1 for r in out)
    assert all(r.is_toxic == 0 for r in out if not r.text)
    assert toxicity.toxicity(empty, known).count() == 0
    none = toxicity.toxicity(docs, known.where("false"))
    assert none.where("is_toxic = 1").count() == 0
