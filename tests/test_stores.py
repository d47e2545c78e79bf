"""Files, versioned store, caches, batch results and streams."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusweave.dimensions import ORACH_CHAYIM, YOREH_DEAH, works_table
from corpusweave.functions import naming
from corpusweave.operators import batch, prompts, versions
from corpusweave.operators.units import (
    drafts_needed,
    expand_ranges,
    interval_rows,
    known_relations,
    plan_requests,
)
from corpusweave.session import scratch_path
from corpusweave.sources import artefacts, batch_files, folders, named_files, snapshots
from corpusweave.sources.payloads import (
    links_from_payloads,
    missing_works,
    number_payload_segments,
    source_segments,
)
from corpusweave.streaming import results as streamed

YD = YOREH_DEAH.key
T0 = datetime(2024, 5, 1, 12, 0, 0)


def test_payload_sources(spark):
    def v(*texts, language="he"):
        return json.dumps({"versions": [{"language": language, "text": list(texts)}]})

    refs = {
        "Tur,_Yoreh_De'ah.94": v("<b>a</b>", ["b", ""]),
        "Shulchan_Arukh,_Yoreh_De'ah.94": v("x", language="en"),
        "Beit_Yosef,_Yoreh_De'ah.94": v(" ", "<i></i>"),
        "Siftei_Kohen_on_Shulchan_Arukh,_Yoreh_De'ah.94": "{broken",
    }
    legacy = {
        "Tur,_Yoreh_De'ah.94": '{"he": ["unused"]}',
        "Shulchan_Arukh,_Yoreh_De'ah.94": '{"he": "&lt;one&gt;"}',
        "Beit_Yosef,_Yoreh_De'ah.94": '{"he": [["q"], "r"]}',
    }
    units = spark.createDataFrame([(YD, 94)], "corpus string, unit int")
    found = source_segments(
        units,
        works_table(spark),
        spark.createDataFrame(list(refs.items()), "ref string, payload string"),
        spark.createDataFrame(list(legacy.items()), "ref string, payload string"),
    )
    assert {r.work: r.segments for r in found.collect()} == {
        "Tur": ["a", "b"], "Beit Yosef": ["q", "r"], "Shulchan Arukh": ["<one>"],
        "Shach": [], "Taz": [],
    }
    numbered = number_payload_segments(found).where("work = 'Beit Yosef'").collect()
    assert sorted((r.seg_no, r.text) for r in numbered) == [(1, "q"), (2, "r")]
    assert {r.work for r in missing_works(found).collect()} == {"Shach", "Taz"}


def test_broken_link_lists_mean_no_links(spark):
    raw = spark.createDataFrame(
        [
            (YD, 1, '[{"ref": "a", "anchorRef": "b", "x": 1}, {"ref": "c"}]'),
            (YD, 2, "[{"),
            (YD, 3, None),
            (YD, 4, "[]"),
        ],
        "corpus string, unit int, payload string",
    )
    got = links_from_payloads(raw).collect()
    assert sorted((r.unit, r.ref, r.anchor_ref) for r in got) == [(1, "a", "b"), (1, "c", None)]


def test_scan_artefact_files(spark, tmp_path):
    files = {
        "Yoreh_Deah_Siman_94_gpt-5_2_draft.txt": "line 1\nline 2",
        "Yoreh_Deah_Siman_94_gpt-5_2_transcript.txt": "spoken",
        "Orach_Chayim_Siman_7_o1_draft_20240501_120000.txt": " ",
        "Orach_Chayim_Siman_7_o1_draft.txt": " ",
        "Orach_Chayim_Siman_8_o1_draft.txt": "",
        "Yoreh_Deah_Relations_94_95_o1.txt": "of two",
        "Yoreh_Deah_Relations_95_96_94_4o-mini_20240501_120000.txt": "of three",
        "Yoreh_Deah_Relations_94__95_o1.txt": "broken range",
        "Yoreh_Deah_Relations_0_1_o1.txt": "broken unit",
        "notes.txt": "x",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = artefacts.scan_artefacts(spark, str(tmp_path)).collect()
    assert {(r.slug, r.unit, r.model, r.kind, r.text) for r in got} == {
        ("Yoreh_Deah", 94, "gpt-5_2", "draft", "line 1\nline 2"),
        ("Yoreh_Deah", 94, "gpt-5_2", "transcript", "spoken"),
        ("Orach_Chayim", 7, "o1", "draft", " "),
        ("Orach_Chayim", 8, "o1", "draft", ""),
    }
    copies = {r.ts and r.ts.isoformat() for r in got if r.unit == 7}
    assert copies == {None, "2024-05-01T12:00:00"}
    assert artefacts.scan_artefacts(spark, str(tmp_path), "*_draft.txt").count() == 3
    relations = artefacts.scan_relations(spark, str(tmp_path)).collect()
    assert {(r.range_key, r.model, r.ts and r.ts.isoformat(), r.text) for r in relations} == {
        ("94-95", "o1", None, "of two"), ("94-96", "4o-mini", "2024-05-01T12:00:00", "of three"),
    }


def test_named_files(spark):
    """One file a row, text or bytes, whole and without leftovers; a second write replaces."""
    path = scratch_path(spark, "named")
    write = named_files.write_named_files
    rows = [("a.txt", "é\n"), ("b c.txt", ""), ("d.txt", None), ("e%20.txt", "x" * 100_000)]
    write(spark.createDataFrame(rows, "name string, content string").repartition(3), path)
    write(spark.createDataFrame([("f.bin", b"\x00\xff"), ("a.txt", b"new")], "name string, content binary"), path)
    write(spark.createDataFrame([], "name string, content string"), path)
    got = {f.name: f.read_bytes() for f in Path(path).iterdir()}
    want = {n: (c or "").encode() for n, c in rows}
    assert got == want | {"f.bin": b"\x00\xff", "a.txt": b"new"}
    with pytest.raises(Exception, match="not a file name"):
        write(spark.createDataFrame([("../x", "y")], "name string, content string"), path)


def test_named_files_on_shelves(spark):
    """Dealt to folders by name, which tasks list; the driver knows the folders alone."""
    path = scratch_path(spark, "shelved")
    rows = [(f"n{i}.txt", "é" * (i % 3)) for i in range(200)]
    files = spark.createDataFrame(rows, "name string, content string")
    named_files.write_named_files(files, path, 4)
    named_files.write_named_files(files.where("name = 'n7.txt'"), path, 4)
    named_files.write_named_files(spark.createDataFrame([("n_loose.txt", "x")], "name string, content string"), path)
    folders_ = [f for f in Path(path).iterdir() if f.is_dir()]
    assert len(folders_) == 4 and sum(1 for f in folders_ for _ in f.iterdir()) == 200
    deeper = Path(path) / "other" / "deep"
    deeper.mkdir(parents=True)
    (deeper / "n_deep.txt").write_text("y")
    got = sorted((r.name, bytes(r.content).decode()) for r in named_files.read_named_files(spark, path).collect())
    assert got == sorted([*rows, ("n_loose.txt", "x"), ("n_deep.txt", "y")])
    dealt = named_files.NamedFileReader(path, "*").partitions()
    assert sum(len(p.paths) for p in dealt) == 2
    assert sorted(p.shelf for p in dealt if p.shelf) == sorted(str(f) for f in folders_)
    some = named_files.read_named_files(spark, path, "n1?.txt")
    assert some.count() == 10


def test_names(spark):
    lit = F.lit
    base = naming.unit_artefact(lit("S"), lit(94), lit("gpt-5.2"), lit("draft"))
    row = spark.range(1).select(
        base.alias("base"),
        naming.history_name(base, F.lit(T0), lit("txt")).alias("history"),
        naming.latest_name(base, lit("txt")).alias("latest"),
        naming.relations_artefact(lit("S"), lit("94_95"), lit("o1")).alias("relations"),
        naming.custom_id_unit(naming.custom_id(lit(94))).alias("unit"),
        naming.custom_id_unit(lit("siman_x_generation")).alias("none"),
    ).first()
    assert row.base == "S_Siman_94_gpt-5_2_draft"
    assert row.history == "S_Siman_94_gpt-5_2_draft_20240501_120000.txt"
    assert row.latest == "S_Siman_94_gpt-5_2_draft.txt"
    assert row.relations == "S_Relations_94_95_o1"
    assert row.unit == 94 and row.none is None


ARTEFACT = (
    "kind string, corpus string, unit_key string, model string, ts timestamp,"
    "version_id int, text string"
)


def artefact(unit, seconds, version, text, kind="draft", corpus=YD):
    return (kind, corpus, unit, "o1", T0 + timedelta(seconds=seconds), version, text)


def test_history_and_latest(spark):
    df = spark.createDataFrame(
        [
            artefact("1", 0.1, 1, "a"),
            artefact("1", 0.9, 2, "b"),
            artefact("1", 5, 3, "c"),
            artefact("1", 5, 4, "d"),
            artefact("2", 3, 5, "e"),
        ],
        ARTEFACT,
    )
    history = versions.version_history(
        df, artefacts.KEYS, F.concat_ws("_", "kind", "unit_key"), "txt", "version_id"
    ).collect()
    # one file per second and key: the last write of the second stays
    assert sorted(r.version_id for r in history) == [2, 4, 5]
    assert len({r.history_name for r in history}) == 3
    latest = versions.latest_versions(df, artefacts.KEYS, "version_id").collect()
    assert {(r.unit_key, r.text) for r in latest} == {("1", "d"), ("2", "e")}
    assert {r.version_id for r in latest} <= {r.version_id for r in history}


def save(spark, rows, store, **how):
    artefacts.save_versions(spark.createDataFrame(rows, ARTEFACT), store, **how)


def latest(spark, store):
    return {(r.kind, r.unit_key): r.text for r in artefacts.read_latest(spark, store).collect()}


def test_versioned_store(spark):
    store = scratch_path(spark, "store")
    save(spark, [artefact("1", 0, 1, "a"), artefact("9", 0, 2, "r", kind="relations")], store)
    save(spark, [artefact("1", 9, 3, "b")], store)
    save(spark, [artefact("1", 5, 4, "between")], store)
    assert artefacts.read_history(spark, store).count() == 4
    assert latest(spark, store) == {("draft", "1"): "b", ("relations", "9"): "r"}


def test_a_batch_saved_twice_is_there_once(spark):
    """What the first save of a batch had and the second lacks is forgotten."""
    store = scratch_path(spark, "store")
    save(spark, [artefact("1", -9, 0, "base"), artefact("3", 0, 0, "other")], store, batch="0")
    save(spark, [artefact("1", 0, 1, "a"), artefact("2", 0, 2, "c"), artefact("4", 0, 2, "gone")], store, batch="7")
    save(spark, [artefact("2", -5, 3, "old")], store, batch="8")
    assert latest(spark, store)[("draft", "1")] == "a"
    save(spark, [artefact("2", 0, 1, "d"), artefact("5", 0, 1, "e")], store, batch="7")
    assert artefacts.read_history(spark, store).count() == 5
    assert latest(spark, store) == {
        ("draft", "1"): "base", ("draft", "2"): "d", ("draft", "3"): "other", ("draft", "5"): "e",
    }
    save(spark, [artefact("2", 0, 1, "d"), artefact("5", 0, 1, "f")], store, batch="7")
    assert latest(spark, store)[("draft", "5")] == "f"


def test_refresh_reads_no_history(spark, monkeypatch):
    """What a merge reads: the new batch and the latest copies of the buckets it touches."""
    store = scratch_path(spark, "store")
    save(spark, [artefact(str(i), 0, i, "a") for i in range(40)], store, batch="1", buckets=8)
    read, reduce = [], versions.latest_versions

    def seen(df, *args):
        read.append(df.inputFiles())
        return reduce(df, *args)

    monkeypatch.setattr(artefacts, "latest_versions", seen)
    monkeypatch.setattr(artefacts, "read_history", lambda *_: 1 / 0)
    before = snapshots.manifest(spark, f"{store}/latest")
    save(spark, [artefact("1", 1, 50, "b")], store, batch="2")
    after = snapshots.manifest(spark, f"{store}/latest")
    assert len(read) == 1 and all("/batch=2/" in f or "/latest/data/" in f for f in read[0])
    changed = [b for b in after["buckets"] if after["buckets"][b] != before["buckets"][b]]
    assert len(before["buckets"]) == 8 and len(changed) == 1
    assert {f.split("bucket=")[1].split("/")[0] for f in read[0] if "bucket=" in f} == set(changed)
    assert latest(spark, store) == {("draft", str(i)): "b" if i == 1 else "a" for i in range(40)}


def test_a_refresh_that_dies_leaves_the_view_before(spark, monkeypatch, caplog):
    """Killed between the write of the rows and the swap; the next save catches up."""
    store = scratch_path(spark, "store")
    save(spark, [artefact("1", 0, 1, "a"), artefact("2", 0, 1, "z")], store)

    def fail(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(folders, "rename_new", fail)
        save(spark, [artefact("1", 1, 2, "b"), artefact("3", 1, 2, "c")], store)
    assert "not refreshed" in caplog.text
    assert artefacts.read_history(spark, store).count() == 4
    assert latest(spark, store) == {("draft", "1"): "a", ("draft", "2"): "z"}
    # a version someone else has published meanwhile is not overwritten
    taken = f"{store}/latest/versions/{2:012d}.json"
    folders.write_text(spark, f"{store}/draft", "{}")
    folders.write_text(spark, taken, "{}")
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        folders.rename_new(spark, f"{store}/draft", taken)
    folders.remove(spark, taken)
    save(spark, [artefact("2", 1, 3, "y")], store)
    assert latest(spark, store) == {("draft", "1"): "b", ("draft", "2"): "y", ("draft", "3"): "c"}


def test_merge_takes_a_numbered_batch_once(spark):
    store = scratch_path(spark, "store")

    def put(rows, **how):
        df = spark.createDataFrame(rows, "k string, n long")
        return snapshots.merge(df, store, ["k"], lambda r: r.groupBy("k").agg(F.sum("n").alias("n")), buckets=4, **how)

    def held():
        return {r.k: r.n for r in snapshots.read_snapshot(spark, store, "k string, n long").collect()}

    assert held() == {}
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, store)
    assert put([("a", 1), ("a", 2), (None, 5)], batch=0) and held() == {"a": 3, None: 5}
    assert not put([("a", 1)], batch=0) and held() == {"a": 3, None: 5}
    assert put([("a", 1), ("b", 1)], batch=3) and held() == {"a": 4, "b": 1, None: 5}
    assert put([], batch=4) and not put([("b", 1)], batch=4) and held() == {"a": 4, "b": 1, None: 5}
    assert put([("b", 9)], instead=spark.createDataFrame([("a",), ("b",)], "k string")) and held() == {"b": 9, None: 5}


def test_context_files(spark):
    path = scratch_path(spark, "contexts")
    rows = [(YD, 94, 1, 2, "a\n\n"), (YD, 94, 2, 2, "b"), (YD, 95, 1, 1, "c")]
    frame = spark.createDataFrame(rows, "corpus string, unit int, part_no int, n_parts int, text string")
    artefacts.write_context_files(frame, path, F.lit("S"), F.lit("o1"))
    assert {f.name: f.read_text() for f in Path(path).iterdir()} == {
        "S_Siman_94_o1_context_1.txt": "a\n\n", "S_Siman_94_o1_context_2.txt": "b",
        "S_Siman_95_o1_context_1.txt": "c",
    }


def test_binary_artefacts(spark):
    schema = ARTEFACT.replace("text string", "text binary")
    store = scratch_path(spark, "store")
    df = spark.createDataFrame([artefact("1", 0, 1, b"\x00\xff")], schema)
    artefacts.save_versions(df, store)
    assert bytes(artefacts.read_latest(spark, store).first().text) == b"\x00\xff"


def test_failing_latest_copy_is_only_a_warning(spark, monkeypatch, caplog):
    def fail(*_):
        raise OSError("locked")

    monkeypatch.setattr(artefacts, "refresh_latest", fail)
    store = scratch_path(spark, "store")
    artefacts.save_versions(spark.createDataFrame([artefact("1", 0, 1, "a")], ARTEFACT), store)
    assert artefacts.read_history(spark, store).count() == 1
    assert "not refreshed" in caplog.text


def test_cache_split(spark):
    needed = spark.createDataFrame([(1,), (2,), (3,)], "unit int")
    cached = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (9, "z")], "unit int, text string")

    def units(split, **kwargs):
        return sorted(r.unit for r in split(needed, cached, ["unit"], "text", **kwargs).collect())

    assert units(versions.cached_needed) == [1]
    assert units(versions.missing_needed) == [2, 3]
    assert units(versions.cached_needed, overwrite=True) == []
    assert units(versions.missing_needed, overwrite=True) == [1, 2, 3]


SPECS = "id int, target_spec string, context_spec string, target_limit int"


def units_in(intervals):
    return [u for i in intervals for u in range(i.lo, i.hi + 1)]


def test_requests_and_needed_drafts(spark):
    specs = spark.createDataFrame(
        [
            (1, "31,33", "32-34", 1),
            (2, "10-11", None, None),
            (3, "x", None, None),
            (4, "5", "7-6", None),
            (5, "5", None, 0),
            (6, "1-999999999999", "3", None),
        ],
        SPECS,
    )
    planned = plan_requests(specs)
    rows = {r.id: r for r in planned.collect()}
    assert units_in(rows[1].context) == [31, 32, 33, 34] and units_in(rows[1].limited) == [31]
    assert rows[1].range_key == "31-34" and rows[1].first_unit == 31
    assert units_in(rows[2].context) == units_in(rows[2].limited) == [10, 11]
    assert {i for i, r in rows.items() if r.error} == {3, 4, 5}
    assert rows[6].range_key == "1-999999999999"
    relations = spark.createDataFrame(
        [("31-34", "known"), ("10-11", "")], "range_key string, text string"
    )
    needed = interval_rows(
        drafts_needed(planned, relations, ["range_key"]).select("id", "needed"), "needed"
    )
    assert sorted(tuple(r) for r in needed.collect()) == [(1, 31, 31), (2, 10, 11), (6, 1, 999999999999)]


def test_relations_that_count(spark):
    """Explicit before cached before none; overwriting forgets what is cached."""
    planned = plan_requests(
        spark.createDataFrame([(i, s, None, None) for i, s in enumerate(["1-2", "1-2", "3", "4"])], SPECS)
    ).withColumnRenamed("id", "request_id")
    given = spark.createDataFrame([(1, "own"), (3, None)], "request_id int, text string")
    cached = spark.createDataFrame([("1-2", "kept"), ("4", "old")], "range_key string, text string")

    def found(**how):
        rows = known_relations(planned, given, cached, ["range_key"], **how).collect()
        return {r.request_id: (r.relations_origin, r.relations) for r in rows}

    assert found() == {0: ("cached", "kept"), 1: ("given", "own"), 2: ("none", ""), 3: ("given", "")}
    assert found(overwrite=True)[0] == ("none", "") and found(overwrite=True)[1] == ("given", "own")


def test_units_meet_intervals(spark, monkeypatch):
    """Interval joins and their gaps against a plain loop, levels and block edges included."""
    from corpusweave.operators import units as u

    monkeypatch.setattr(u, "GAP_BLOCK", 8)
    rng = random.Random(6)
    specs = ["1-200", "64-127", "63,128-129", "4096", "1-1000000000000", "5000-70000", "9-9,11,13-40"]
    specs += [",".join(f"{a}-{a + rng.randint(0, 99)}" for a in rng.sample(range(1, 9000), 5)) for _ in range(30)]
    there = {rng.randint(1, 9000) for _ in range(800)} | {1, 63, 64, 127, 128, 4096, 70000, 10**12}
    requests = plan_requests(spark.createDataFrame([(i, s, None, None) for i, s in enumerate(specs)], SPECS))
    requests = requests.select("id", F.lit("c").alias("corpus"), "targets")
    held = spark.createDataFrame([("c", n) for n in there] + [("other", 2)], "corpus string, unit long")
    lists = {r.id: r.targets for r in requests.collect()}
    want, gaps = set(), set()
    for i, intervals in lists.items():
        for x in intervals:
            inside = sorted(n for n in there if x.lo <= n <= x.hi)
            want |= {(i, n, x.before + n - x.lo) for n in inside}
            marks = [x.lo - 1, *inside, x.hi + 1]
            gaps |= {(i, a + 1, b - 1, b - a - 1) for a, b in zip(marks, marks[1:]) if b - a > 1}
    met = u.in_intervals(requests, "targets", held, ["corpus"])
    assert sorted((r.id, r.unit, r["rank"]) for r in met.collect()) == sorted(want)
    missing = u.missing_units(requests, "targets", held, ["corpus"], ["id"])
    assert sorted((r.id, r.lo, r.hi, r.n_units) for r in missing.collect()) == sorted(gaps)
    assert u.missing_units(requests, "targets", held.where("false"), ["corpus"], ["id"]).count() == sum(map(len, lists.values()))


def test_long_specs_are_whole_as_rows(spark):
    specs = spark.createDataFrame([("5,1-250000,249999-250001",)], "spec string")
    row = expand_ranges(specs).agg(
        F.count("*"), F.countDistinct("unit"), F.min("unit"), F.max("unit"),
        F.count_if(F.col("unit") == F.col("unit_no")),
    ).first()
    assert tuple(row) == (250001, 250001, 1, 250001, 250001)


def test_batch_request_lines(spark):
    rows = [(YD, 94, 1, 1, "ש", None), (YD, 95, 1, 2, "p", None), (YD, 95, 2, 2, "q", None)]
    df = spark.createDataFrame(
        rows, "corpus string, unit int, part_no int, n_parts int, text string, error string"
    )
    made = {
        m: {r.unit: r for r in prompts.batch_requests(df, F.lit(m), F.lit("i"), F.lit(0.3)).collect()}
        for m in ("o1", "gpt-5.2")
    }
    assert json.loads(made["o1"][94].request) == {
        "custom_id": "siman_94_generation",
        "method": "POST",
        "url": "/v1/chat/completions",
        "body": {
            "model": "o1",
            "messages": [
                {"role": "developer", "content": "i"}, {"role": "user", "content": "ש"},
            ],
        },
    }
    body = json.loads(made["gpt-5.2"][94].request)["body"]
    assert body["temperature"] == 0.3 and body["messages"][0]["role"] == "system"
    assert "ש" in made["o1"][94].request
    assert json.loads(made["o1"][95].request)["body"]["messages"][1]["content"] == "pq"
    path = scratch_path(spark, "requests")
    batch_files.write_requests(prompts.batch_requests(df, F.lit("o1"), F.lit("i"), F.lit(0.3)), path)
    assert sorted(json.loads(r.value)["custom_id"] for r in spark.read.text(path).collect()) == [
        "siman_94_generation", "siman_95_generation",
    ]


def test_service_tier_only_when_given(spark):
    lit = F.lit
    bodies = [
        F.to_json(prompts.chat_body(lit("gpt"), lit("i"), lit("p"), lit(prompts.POLISH_TEMPERATURE),
                                    tier))
        for tier in (None, lit(""), lit("flex"))
    ]
    row = spark.range(1).select(*[b.alias(f"b{i}") for i, b in enumerate(bodies)]).first()
    tiers = [json.loads(b).get("service_tier") for b in row]
    assert tiers == [None, None, "flex"] and json.loads(row[0])["temperature"] == 0.1


def line(id_, content="c", **extra):
    body = {"choices": [{"message": {"content": content}}]}
    return json.dumps({"custom_id": id_, "response": {"status_code": 200, "body": body}, **extra})


LINES = [
    "",
    json.dumps({"custom_id": "siman_1_generation", "error": {"code": "x"}}),
    line("siman_1_generation", "first", id="r1"),
    line("siman_1_generation", "second"),
    "  ",
    '{"custom_id": "siman_2_generation", "resp',
    json.dumps({"custom_id": "siman_3_generation", "response": {"body": {}}}),
]


def test_result_lines(spark, tmp_path):
    (tmp_path / "out.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    parsed = batch.parse_results(batch_files.read_result_lines(spark, str(tmp_path)))
    assert parsed.count() == 5
    results = batch.first_usable(parsed, batch_files.LINE_ORDER)
    assert [tuple(r) for r in results.collect()] == [("siman_1_generation", "first")]
    asked = spark.createDataFrame(
        [("siman_1_generation",), ("siman_3_generation",)], "custom_id string"
    )
    late = results.union(spark.createDataFrame([("siman_9_generation", "z")], results.schema))
    states = {r.custom_id: r.state for r in batch.join_results(asked, late).collect()}
    assert states == {
        "siman_1_generation": "complete",
        "siman_3_generation": "pending",
        "siman_9_generation": "orphan",
    }


def test_status_routes(spark):
    states = ["completed", "completed", "validating", "in_progress", "finalizing", "cancelled"]
    rows = [(i, s, i != 1) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "i int, s string, has boolean")
    got = df.select("i", batch.route_status(F.col("s"), F.col("has")).alias("r")).orderBy("i")
    assert [r.r for r in got.collect()] == [
        "keep", "failed", "pending", "pending", "failed", "failed",
    ]


def test_error_lines(spark):
    """Every line that gives no content says why; the counts are those of the rows."""
    lines = [*LINES, json.dumps({"response": {"body": {"choices": []}}}), line(""), "[1]", "null", line("siman_4_generation", None)]
    frame = spark.createDataFrame(list(enumerate(lines)), "no int, value string")
    seen = Observation()
    parsed = batch.observed(batch.parse_results(frame), seen)
    rows = parsed.collect()
    assert {r.no: r.error for r in rows if r.error} == {
        1: "no content", 5: "broken line", 6: "no content", 7: "no custom id", 8: "no custom id",
        9: "broken line", 10: "broken line",
    }
    assert {r.no for r in rows if r.is_usable} == {2, 3, 11}
    assert seen.get == {"lines": 10, "usable": 3, "broken": 3, "no_id": 2, "no_content": 2}
    errors = {r.no: (r.custom_id, r.line_text) for r in batch.result_errors(parsed, ["no"]).collect()}
    assert errors[5] == (None, lines[5]) and errors[6] == ("siman_3_generation", lines[6]) and len(errors) == 7


def test_stream_keeps_one_row_per_request(spark, tmp_path):
    """Two jobs with the same units; replays, late duplicates, orphans, pending requests."""
    landing = tmp_path / "landing"
    store, offsets = scratch_path(spark, "store"), scratch_path(spark, "offsets")
    assert streamed.ingested(spark, store).count() == streamed.ingest_errors(spark, store).count() == 0
    assert streamed.ingest_counts(spark, store).count() == 0
    ids = [f"siman_{n}_generation" for n in (1, 2, 3)]
    asked = spark.createDataFrame([(j, i) for j in "AB" for i in ids[:2]], "job string, custom_id string")
    streamed.register_requests(asked, store)

    def land(job, name, *lines):
        (landing / f"job={job}").mkdir(parents=True, exist_ok=True)
        (landing / f"job={job}" / name).write_text("\n".join(lines), encoding="utf-8")

    def ingest(files_per_batch=1):
        stream = streamed.result_stream(spark, str(landing), files_per_batch=files_per_batch)
        streamed.ingest_results(stream, store, offsets).awaitTermination()
        rows = streamed.ingested(spark, store).collect()
        got = {(r.job, r.custom_id[6]): (r.state, r.content, r.n_duplicates, r.n_failed) for r in rows}
        assert len(got) == len(rows)
        return got

    land("A", "a.jsonl", *LINES)
    first = {
        ("A", "1"): ("complete", "first", 1, 1), ("A", "2"): ("pending", None, 0, 0),
        ("A", "3"): ("failed", None, 0, 1),
        ("B", "1"): ("pending", None, 0, 0), ("B", "2"): ("pending", None, 0, 0),
    }
    assert ingest() == first
    assert ingest() == first  # nothing new: nothing changes
    land("B", "b.jsonl", line(ids[0], "of B"), line(ids[2], "unasked"))
    land("A", "c.jsonl", line(ids[0], "repeated"), line(ids[1], "late"), "{")
    second = {
        ("A", "1"): ("complete", "first", 2, 1), ("A", "2"): ("complete", "late", 0, 0),
        ("A", "3"): ("failed", None, 0, 1), ("B", "1"): ("complete", "of B", 0, 0),
        ("B", "2"): ("pending", None, 0, 0), ("B", "3"): ("orphan", "unasked", 0, 0),
    }
    assert ingest() == second
    errors = sorted((r.batch_id, r.job, r.error) for r in streamed.ingest_errors(spark, store).collect())
    assert [(j, e) for _, j, e in errors] == [
        ("A", "broken line"), ("A", "no content"), ("A", "no content"), ("A", "broken line"),
    ]
    counts = streamed.ingest_counts(spark, store).agg(F.sum("lines"), F.sum("usable"), F.sum("broken"), F.sum("no_content"))
    assert tuple(counts.first()) == (10, 6, 2, 2)


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """Killed after the merge was published and before the stream took note of it."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    store, offsets = scratch_path(spark, "store"), scratch_path(spark, "offsets")
    merge = snapshots.merge

    def dies(*args, **kwargs):
        merge(*args, **kwargs)
        raise OSError("killed")

    def ingest():
        streamed.ingest_results(streamed.result_stream(spark, str(tmp_path / "in")), store, offsets).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(snapshots, "merge", dies)
        with pytest.raises(Exception, match="killed"):
            ingest()
    ingest()
    rows = {r.custom_id: (r.content, r.n_duplicates, r.n_failed) for r in streamed.ingested(spark, store).collect()}
    assert rows == {"siman_1_generation": ("first", 1, 1), "siman_3_generation": (None, 0, 1)}
    assert streamed.ingest_errors(spark, store).count() == 3


def test_corpora_differ(spark):
    works = {r.corpus: [] for r in works_table(spark).collect()}
    assert set(works) == {YD, ORACH_CHAYIM.key}


def test_many_small_files_go_in_waves(spark, monkeypatch, tmp_path):
    """No more files than a wave has lie there at a time, none stay, and the rows are the same."""
    from corpusweave.plans import catalog

    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, catalog.relations_scan(spark, sf).collect()))
    held, write = [], catalog.artefacts.write_artefact_files

    def written(artefacts, path, shelves=0):
        write(artefacts, path, shelves)
        held.append(sum(1 for p in tmp_path.rglob("*_Relations_*.txt")))

    monkeypatch.setattr(catalog.artefacts, "write_artefact_files", written)
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(catalog, "WAVE_FILES", len(want) // 3, raising=False)
    got = sorted(map(str, catalog.relations_scan(spark, sf).collect()))
    assert got == want and sum(held) == len(want) > 100
    assert max(held) < len(want) / 2 and not list(tmp_path.rglob("*_Relations_*.txt"))
