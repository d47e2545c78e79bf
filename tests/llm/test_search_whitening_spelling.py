"""Top-k search, whitening and spelling variants against plain versions."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from corpusweave.llm import spelling, topk, whitening
from corpusweave.llm.queries import LLM_QUERIES
from corpusweave.llm.sql import LLM_ORACLES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- exact top-k ------------------------------------------------------------


def plain_top_k(rows, k=5):
    """``rows`` of (id, vector, asks) → (query_id, rank, vec_id, score)."""
    ints = [(i, [int(np.floor(256 * np.float64(c))) for c in v], a) for i, v, a in rows]
    scores = {}
    for i, v, a in ints:
        if a:
            found = scores.setdefault(i, {})
            for j, w, _ in ints:
                if i != j:
                    s = min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1)
                    found[j] = max(found.get(j, s), s)
    return sorted(
        (
            (i, rank, j, s)
            for i, found in scores.items()
            for rank, (j, s) in enumerate(sorted(found.items(), key=lambda p: (-p[1], p[0]))[:k], 1)
        ),
        key=repr,
    )


def test_registered_top_k(spark):
    got = LLM_QUERIES["op11_exhaustive_top_k"](spark, SF)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(LLM_ORACLES["op11_exhaustive_top_k"]).fetchall()
    assert rows_of(got) == sorted(want, key=repr)
    given = con.execute("select vec_id, embedding, vec_id % 50 = 0 from embeddings").fetchall()
    assert rows_of(got) == plain_top_k(given)


def test_top_k_in_blocks(spark, monkeypatch):
    """Several blocks of both kinds, rare and frequent terms, ties, rows that repeat an id."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(1)
    sparse = rng.integers(-2, 3, (120, 12)) * (rng.random((120, 12)) < 0.4) / 256
    rows = [(i - 20, v.tolist(), i % 3 == 0) for i, v in enumerate(sparse)]
    rows += [rows[5], rows[6], (rows[9][0], rows[4][1], False), (7, [1.0, 2.0], True), (900, [], True)]
    rows += [(901, [3e7] * 12, False), (902, [-3e9] * 12, True)]
    odd = [(910, None, True), (911, [1.0, None], True), (912, [float("nan")], True), (913, [float("inf")], False)]
    odd += [(None, [1.0] * 12, True)]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, asks boolean")
    # clashing names and a map are only carried past
    frame = frame.select("*", F.col("asks").alias("query"), F.lit("x").alias("meet"), F.create_map(F.lit(1), "vec_id").alias("weights"))
    assert rows_of(topk.top_k(frame, F.col("query"))) == plain_top_k(rows)
    assert rows_of(topk.top_k(frame, F.col("query"), k=500)) == plain_top_k(rows, 500)
    assert topk.top_k(frame.where("false"), F.col("query")).count() == 0
    assert topk.top_k(frame.where("vec_id = 900"), F.col("query")).count() == 0
    assert topk.top_k(frame, F.lit(None).cast("boolean")).count() == 0


def test_huge_components_end_at_long(spark):
    rows = [(0, [1e300, 1.0], True), (1, [1e300, 0.0], False), (2, [-1e300, 1.0], False)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, asks boolean"), F.col("asks"))
    assert rows_of(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


# --- whitening --------------------------------------------------------------


def plain_whitening(rows, components=8):
    ids = [i for i, _ in rows]
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = ((n * x - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return ids, n, deviation, centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def same_whitening(got, rows):
    ids, n, deviation, w, explained = plain_whitening(rows)
    k = w.shape[1]
    assert len(got) == len(ids) * k
    placed = {}
    for r in got:
        placed.setdefault((r.vec_id, r.component, r.deviation), []).append(r)
    signs = {}
    for at, i in enumerate(ids):
        for c in range(1, k + 1):
            r = placed[(i, c, deviation[at])].pop()
            assert r.n == n
            assert abs(r.explained - explained[c - 1]) < 1e-9 and r.identity_error < 1e-9
            if abs(w[at, c - 1]) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(r.whitened * w[at, c - 1]))
            assert abs(abs(r.whitened) - abs(w[at, c - 1])) < 1e-7
    assert all(len(s) == 1 for s in signs.values())


def test_registered_whitening(spark):
    got = LLM_QUERIES["op12_chebyshev_whitening"](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    assert kinds == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    given = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    same_whitening(got.collect(), given)


def test_filter_runs_until_certified(spark):
    """A flat spectrum of 80 dimensions: the block alone does not hold it."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 80)) * np.linspace(1.3, 1, 80)
    rows = spark.createDataFrame([([int(v) for v in r],) for r in np.floor(1024 * x)], "x array<bigint>")
    found = whitening.fit(rows, 80)
    c = np.floor(1024 * x) - np.floor(1024 * x).mean(axis=0)
    e = np.linalg.eigvalsh(c.T @ c / 600)[::-1][:8]
    assert found.passes > whitening.DEGREE and found.residual < 1e-11
    assert np.allclose(found.eigenvalues, e, rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    # five different vectors: four components
    base = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((5, 40)))]
    rows = [*base, base[1], (1, base[2][1])]
    odd = [(20, None), (21, [1.0, None]), (22, [float("nan")] * 40), (23, [1.0, 2.0]), (24, []), (25, [float("-inf")])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    frame = frame.select("*", F.lit(1).alias("x"), F.lit(2).alias("n"), F.create_map(F.lit(1), "vec_id").alias("m"))
    got = whitening.whitened(frame).collect()
    same_whitening(got, rows)
    assert max(r.component for r in got) == 4
    assert whitening.whitened(frame.where("false")).count() == 0
    assert whitening.whitened(frame.where("vec_id = 0")).count() == 0
    assert whitening.whitened(frame.where("vec_id in (21, 24)")).count() == 0
    # fewer dimensions than components, ids that are null, entries whose deviation a long can't hold
    few = [(None, [0.5, 1.0]), (3, [0.25, 0.0]), (4, [7.0, 1.0])]
    got = whitening.whitened(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()
    same_whitening(got, few)
    wide = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(wide, "vec_id long, embedding array<double>"))
    assert got.where("deviation is null").count() == 2


# --- spelling ---------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(docs):
    counted = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    n = {w: c for w, c in counted.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in n}
    holes = {}
    for w in n:  # words one edit apart share a word with a hole, or one is the other with a letter cut
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    for (head, tail), group in holes.items():
        for w in [*group, head + tail] if head + tail in n else group:
            near[w].update(v for v in [*group, head + tail] if v in n and one_edit(v, w))
    form = {}
    for w, others in near.items():
        if others:
            top = min(others, key=lambda o: (-n[o], o))
            if n[top] >= 2 * n[w]:
                form[w] = top

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(
        ((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr
    )


def test_registered_variants(spark):
    got = LLM_QUERIES["op13_spelling_variants"](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    assert kinds == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint",
    }
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = plain_variants(docs)
    assert len(want) > 500 and any(w[1] != w[2] for w in want if w[1])
    assert rows_of(got) == want


def test_variants_of_odd_words(spark):
    chain = " ".join(["words"] * 3 + ["wordsx"] * 6 + ["wordsxy"] * 12 + ["wordsxyz"] * 24 + ["awordsxyz"] * 48)
    ties = " ".join(["letter"] * 4 + ["lettera"] * 8 + ["letterb"] * 8 + ["Letterc"] * 7 + ["aaaab", "aaab", "aaaaab"] * 3)
    docs = [
        (0, chain), (1, ties), (2, None), (3, ""), (4, "été×÷ ÉTÉ×÷ été×÷ 123 éTÉ×÷ a-b_c"), (None, "nameless " * 5),
        (5, "x" * 70_000 + " " + ("longest" * 9_000) + " "), (5, ("y" * 3000 + " ") * 4), (1, ties), (6, "😀words😀 straße STRASSE straße straße"),
    ]
    docs = [(i, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t) for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame = frame.select("*", F.lit("w").alias("word"), F.lit(1).alias("n"), F.create_map(F.lit(1), "doc_id").alias("key"))
    assert rows_of(spelling.variants(frame)) == plain_variants(docs)
    assert spelling.variants(frame.where("false")).count() == 0
    assert spelling.variants(frame.where("doc_id in (2, 3)")).count() == 0


def test_near_words_are_whole(spark):
    """All strings over few letters: every kind of edit, equal neighbours, equal symbols."""
    from itertools import product

    listed = ["".join(p) for length in (5, 6) for p in product("aàz", repeat=length)]
    vocabulary = spark.createDataFrame([(w, 1) for w in listed], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_words(vocabulary).collect()}
    assert got == {(a, b) for a in listed for b in listed if one_edit(a, b)}
    assert spelling.near_words(vocabulary).count() == len(got)
