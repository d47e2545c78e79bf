"""URL rules, main text, neighbours and vector links against plain versions; the pipeline."""

import duckdb
import numpy as np

import corpus_pipeline
from corpusweave.llm import html_text, neighbours, urls, vector_links
from corpusweave.llm.queries import LLM_QUERIES, URL_RULES
from corpusweave.llm.sql import URL_FILTERS
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    given = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org/en/12",
        "https://example.org/en/2", "x://com", "x://www.com/fr/", "x://b.com/de/?a", "x://notcom/de/",
        "x://example.org?/es/", "x://example.org/es/", "x://example.org/es/", "a://b://org/", "x://É.org/",
    ]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = urls.judge_urls(pages, rules).collect()
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in rows}
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(given)))
    want = {given[r[0]]: r[1:] for r in con.execute(URL_FILTERS).fetchall()}
    assert got == want and len(rows) == len(want)
    assert urls.judge_urls(pages.where("false"), rules).count() == 0
    assert urls.judge_urls(pages, rules.where("false")).where("rule is not null").count() == 0


FRAME = (
    '<html><head><title>T</title><style>p{{}}</style></head><body><header>top</header><nav><a>m</a></nav>'
    '<div class="ad">buy this now, a long advert that says more than the page</div>'
    '<div class="post-{n}"><h1>Title {n}</h1><p>One &amp; two<br>three<p>{body}<ul><li>i<li>j</ul>'
    '<div class="comments"><p>reader says</p></div><form>f<input></form></div>'
    '<aside>side</aside><script>var t="</p>";</script><footer>&copy;</footer></body></html>'
)


def test_main_text(spark):
    rows = [(n, "http://H.org/a", FRAME.format(n=n, body="word " * 40)) for n in range(5)]
    rows.append((9, "http://h.org/b", FRAME.format(n=9, body="tiny")))
    rows += [(10, None, None), (11, "http://h.org/c", ""), (12, "x", "plain text"), (13, "x", "<p>open <b>end")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    got = {r.record.page_id: r.main_text for r in html_text.main_text(pages).collect()}
    assert got[9] == "Title 9\nOne & two three\ntiny\ni\nj"
    assert got[0] == "Title 0\nOne & two three\n" + ("word " * 40).strip() + "\ni\nj"
    assert (got[10], got[11], got[12], got[13]) == ("", "", "plain text", "open end")
    assert html_text.main_text(pages).count() == len(rows) + 1
    assert html_text.main_text(pages.where("false")).count() == 0


ARTICLE = "<h1>T</h1><p>" + "said in the article " * 20 + "</p>"


def main_text_of(source):
    page = html_text.parse(source)
    path = html_text.best_path(page)
    return path and html_text.text_under(page, path.key) or ""


def test_loose_marks_do_not_remove_the_article():
    want = "T\n" + ("said in the article " * 20).strip()
    for wrapper in (
        'div class="content has-sidebar"', 'div class="post share-enabled"', 'div id="page-header-fixed"',
        'div style="overflow:hidden"', 'div data-link="/the-hidden-cost"', 'div aria-hidden="false"',
        'div data-id="sidebar"', 'article title="a hidden one"', "div class=widget",
    ):
        tag = wrapper.split()[0]
        source = f"<body><div class=ad>buy now</div><{wrapper}>{ARTICLE}<div class=comments>c</div></{tag}></body>"
        assert main_text_of(source) == want, wrapper
        assert main_text_of(f"<body>loose<div>{source}</div></body>").endswith(want), wrapper
    assert main_text_of(f'<body style="overflow:hidden">{ARTICLE}</body>') == want
    assert main_text_of(f"<body>{ARTICLE}<div hidden>h</div><div HIDDEN=''>h</div></body>") == want
    # an id is no part of a path, but the mark is
    assert main_text_of(f"<body><div>{ARTICLE}</div><div id=footer>f</div></body>") == want
    assert main_text_of("<body><div class=ad>only this</div></body>") == "only this"
    assert main_text_of("<p>one <a class=share>x</a> two <b>three</b></p>") == "one two three"
    assert main_text_of("<body><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></body>") == "so x=1 holds"


def test_attributes_are_read_as_browsers_do():
    assert main_text_of("<p title=it's>one</p><p>two</p><p>don't stop</p><p>rest</p>") == "one\ntwo\ndon't stop\nrest"
    assert main_text_of('<p><a href="x"">one</a> two</p>') == "one two"
    assert main_text_of("<p data-x='a>b' class = \"c>d\">one</p><p title='open>two</p>") == "one\ntwo"
    assert main_text_of("<p x=a\"b>one</p><p hidden=>two</p><p>three") == "one\nthree"
    body = ("said in the article " * 20).strip()
    assert main_text_of(f"<article><header><h1>T</h1></header><p class='note share'>{body}</p><p>x</p></article>") == f"T\n{body}\nx"
    assert main_text_of(f"<body><header>top</header><div>{ARTICLE}</div><p class=ad>buy</p></body>") == f"T\n{body}"


def test_deep_pages_take_memory_in_proportion():
    import time
    import tracemalloc

    def cost(source):
        tracemalloc.start()
        began = time.process_time()
        text = main_text_of(source)
        taken = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return text, *taken

    for opening in ("<div>x", "<div class=ad>x", "<b>x", "<ul><li>x", "<b><p>x", "<article>x", "</i><span>x"):
        some, t1, m1 = cost(opening * 4000 + "end")
        many, t2, m2 = cost(opening * 16_000 + "end")
        assert some.endswith("end") and many.endswith("end")
        assert m2 < 6 * m1 and t2 < 8 * t1 + 1, opening
        assert m2 < 60e6


def test_main_text_beyond_the_broadcast(spark, monkeypatch):
    """Many hosts, one with a third of the pages; columns of clashing names, a map; null columns."""
    rows = [(n, f"http://h{n % 40 if n % 3 else 0}.org/", FRAME.format(n=n, body=f"word{n} " * 30)) for n in range(120)]
    rows += [(900, None, None), (901, "http://h1.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.select("*", F.lit("x").alias("host"), F.lit(1).alias("path"), F.lit(2).alias("part"), F.create_map(F.lit(1), "url").alias("m"))
    want = {r.record.page_id: r.main_text for r in html_text.main_text(pages).collect()}
    assert want[3].startswith("Title 3\n") and want[900] == want[901] == "" and len(want) == 122
    monkeypatch.setattr(html_text, "MOST_WINNERS", 3)
    monkeypatch.setattr(html_text, "PART_PAGES", 7)
    got = html_text.main_text(pages).collect()
    assert {r.record.page_id: r.main_text for r in got} == want and got[0].record.host == "x"


def vectors(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((400, 24)).astype("f4")
    v[50:60] = v[5] + 0.05 * rng.standard_normal((10, 24))
    v[60:64] = v[6]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, x) for i, x in enumerate(odd)] + [(None, v[7].tolist()), rows[8]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_vector_links(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(x, float)) if x and len(x) in (2, 24) and None not in x and np.isfinite(x).all() and any(x) else (i, None) for i, x in rows]
    links = [0] * len(rows)
    top = list(range(len(rows)))
    for a, (_, x) in enumerate(good):
        for b, (_, y) in enumerate(good):
            if a != b and x is not None and y is not None and len(x) == len(y):
                links[a] += x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95
    for _ in range(4):
        for a, (_, x) in enumerate(good):
            for b, (_, y) in enumerate(good):
                if x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    top[a] = top[b] = min(top[a], top[b])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top[k]] = min(least.get(top[k], 1 << 60), 1 << 60 if i is None else i)
    want = sorted((str(i), links[k], least[top[k]]) for k, (i, _) in enumerate(rows))
    got = vector_links.vector_links(df).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == want
    assert vector_links.vector_links(df.where("false")).count() == 0


def plain_links(rows, cosine=0.95):
    """(n_links, component) of each row by all pairs, in double precision."""
    x = np.array([v for _, v in rows], float)
    c = x @ x.T / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((x * x).sum(axis=1))
    near = c >= cosine
    top = np.arange(len(rows))
    for _ in range(12):
        top = np.array([top[n].min() for n in near])
    ids = np.array([i for i, _ in rows])
    return {i: (int(n.sum()) - 1, int(ids[top == t].min())) for i, n, t in zip(ids.tolist(), near, top)}


def test_a_hot_cell_goes_in_pieces(spark, monkeypatch):
    """One common direction that a third of all vectors lean to, more than a piece of members and
    of visitors; a common vector; links right at the threshold."""
    monkeypatch.setattr(vector_links, "CELL", 64)
    rng = np.random.default_rng(11)
    v = rng.standard_normal((900, 32))
    v[:300] = v[0] + 0.22 * np.linalg.norm(v[0]) / np.sqrt(32) * rng.standard_normal((300, 32))
    v[300:330] = v[299]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "*", F.lit(1).alias("cell"), F.lit(2).alias("member"), F.create_map(F.lit(1), "vec_id").alias("copies")
    )
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.vector_links(df).collect()}
    assert got == plain_links(rows)
    assert max(n for n, _ in got.values()) > 128
    # cos = 3/5 * 4/5 * 2 = 0.96 exactly, in vectors whose unit vectors can't be written down
    exact = [(0, [3.0, 4.0]), (1, [4.0, 3.0]), (2, [30.0, 40.0]), (3, [-3.0, -4.0])]
    small = spark.createDataFrame(exact, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.vector_links(small, cosine=0.96).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}


def test_whole_vectors_meet_only_where_they_are_near(spark, monkeypatch):
    """Rows without a near one are sent to their cells with the coordinates of a block alone."""
    monkeypatch.setattr(vector_links, "CELL", 128)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((2000, 64)).astype(np.float32)
    v[1990:] = v[:10] + rng.normal(0, 0.2, (10, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent = {}

    def counted(kind, run):
        def meet(dealt, *args):
            cells = [F.size(c) * 4 if t.startswith("array") else F.octet_length(c) for c, t in dealt.dtypes if t == "binary" or t.startswith("array")]
            sent[kind] = dealt.agg(F.sum(sum(cells))).first()[0] or 0
            return run(dealt, *args)
        return meet

    for name in ("grouped", "in_groups"):
        if hasattr(vector_links, name):
            monkeypatch.setattr(vector_links, name, counted(name, getattr(vector_links, name)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.vector_links(df).collect()}
    assert got == plain_links(rows)
    assert sum(n for n, _ in got.values()) == 20
    # about 24 copies of a row; of whole vectors a copy would be 256 bytes
    assert sent["grouped"] < 200 * 256
    assert sum(sent.values()) < 2000 * 64 * 4 * 8


def test_near_rows_of_a_block():
    """Every pair within the limit is found, as if all were compared; a row is not its own partner."""
    rng = np.random.default_rng(6)
    part = 0.3 * rng.standard_normal((300, 16))
    part[200:] = part[:100] + rng.normal(0, 0.03, (100, 16))
    places = np.rint(part.clip(-1, 1) * vector_links.ONE).astype(np.int16)
    ids = np.arange(300)
    visits, visited = vector_links.near_rows(ids, places, ids[:250], places[:250], 0.01)
    apart = ((part[:, None] - part[None, :250]) ** 2).sum(axis=2) + 9 * (ids[:, None] == ids[:250])
    assert (visits >= (apart <= 0.01).any(axis=1)).all() and (visited >= (apart <= 0.01).any(axis=0)).all()
    assert (visits <= (apart <= 0.0101).any(axis=1)).all() and 0 < visits.sum() < 300
    assert not vector_links.near_rows(ids, places, ids[:0], places[:0], 0.01)[0].any()


def test_nearest(spark):
    rows, df = vectors(spark)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, leaf=32, share=1.5).collect()
    good = {i: np.array(x, float) for i, x in rows if i is not None and x and len(x) == 24 and None not in x and np.isfinite(x).all() and any(x)}
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, parts in found.items():
        want = sorted((np.sqrt(((good[i] - good[q]) ** 2).sum()), i) for i in good if i != q)[:10]
        parts.sort()
        assert [p[0] for p in parts] == list(range(1, 11))
        for _, i, score in parts:
            assert abs(score - np.sqrt(((good[i] - good[q]) ** 2).sum())) < 1e-12
        hits += len({i for _, i in want} & {p[1] for p in parts})
    assert hits >= 0.9 * 10 * len(found)
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_nearest_with_every_row_repeated(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((150, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    # each row three times, and once more with a vector far off: the smaller distance counts
    rows = rows * 3 + [(i, (v[i] + 50).tolist()) for i in range(1, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 0, leaf=1000).orderBy("rank").collect()
    far = np.sqrt(((v - v[0]) ** 2).sum(axis=1))
    assert [r.vec_id for r in got] == np.argsort(far)[1:11].tolist()
    assert np.allclose([r.score for r in got], np.sort(far)[1:11])


def test_queries_and_pipeline(spark):
    for n in range(1, 11):
        assert [k for k in LLM_QUERIES if k.startswith(f"op{n}_")], n
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).repartition(2).cache()
    extra = docs.union(docs.limit(1)).withColumn("node", F.lit("x"))
    kept = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.columns, stage(spark, kept, SF).cache()
        assert kept.columns == before, name
    assert 0 < kept.count() < extra.count()
    assert kept.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
