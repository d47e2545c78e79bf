import html
import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import units

from corpusweave.functions import numerals, payloads, ranges, refs, templates, text

RANDOM = random.Random(4)


def some_parts():
    """Up to six parts (low, high) that may repeat, touch and overlap."""
    lows = [RANDOM.randint(1, 400) for _ in range(RANDOM.randint(1, 6))]
    return [(low, low + RANDOM.choice([0, 0, 1, 7, 30])) for low in lows]


def written(parts):
    """A spec of the parts, spaces thrown in, single units plain or as a range of one."""
    shown = [f"{a}" if a == b and RANDOM.random() < 0.7 else f"{a}-{b}" for a, b in parts]
    return "".join(c + " " * (RANDOM.random() < 0.1) for c in ",".join(shown))


PARTS = [some_parts() for _ in range(300)]
SPECS = [written(p) for p in PARTS]


def listed(intervals):
    return None if intervals is None else [u for i in intervals for u in range(i.lo, i.hi + 1)]


def intervals_of(x):
    return ranges.intervals_of(x, ranges.spec_error(x).isNull())


def test_specs_are_the_units_of_their_parts(column):
    got = column(SPECS, intervals_of)
    assert [listed(i) for i in got] == [sorted({u for a, b in p for u in range(a, b + 1)}) for p in PARTS]
    assert all(i.hi + 1 < j.lo for row in got for i, j in zip(row, row[1:]))
    assert column(SPECS, ranges.spec_error) == [None] * len(SPECS)


def test_interval_text_is_a_spec_of_the_same_units(column):
    shown = column(SPECS, lambda x: ranges.interval_text(ranges.spec_intervals(x)))
    assert column(shown, intervals_of) == column(SPECS, intervals_of)
    assert column(shown, lambda x: ranges.interval_text(ranges.spec_intervals(x))) == shown


@pytest.mark.parametrize(
    "spoil",
    [
        lambda spec: spec + RANDOM.choice("abz;:+._/*\t\n\u0661\u00a0"),
        lambda spec: RANDOM.choice([spec + ",", "," + spec, spec + ",," + spec, spec + ", ,1"]),
        lambda spec: spec + RANDOM.choice([",0", ",0-2", ",00"]),
        lambda spec: spec + f",{RANDOM.randint(60, 90)}-{RANDOM.randint(1, 59)}",
        lambda spec: spec + RANDOM.choice([",-", ",2-", ",-2", ",1-2-3", ",1--3"]),
        lambda spec: spec + "," + "8" * RANDOM.randint(14, 60),
    ],
)
def test_one_bad_part_spoils_a_spec(column, spoil):
    bad = [spoil(spec) for spec in SPECS[:40]]
    assert all(column(bad, ranges.spec_error))
    assert column(bad, intervals_of) == [None] * len(bad)


def test_nothing_is_no_spec(column):
    assert column([None, "", " ", "\t \n"], ranges.spec_error) == ["empty spec"] * 4


def test_huge_bounds_are_errors_of_their_row(spark, column):
    huge = ["1-9223372036854775807,5", "1-9223372036854775808", f"{ranges.MAX_UNIT + 1}", "7"]
    assert column(huge, ranges.spec_error) == ["number too large"] * 3 + [None]
    specs = spark.createDataFrame([(s,) for s in huge], "spec string")
    assert [r.unit for r in units.expand_ranges(specs).collect()] == [7]
    last = f"{ranges.MAX_UNIT - 1}-{ranges.MAX_UNIT}"
    assert listed(column([last], intervals_of)[0]) == [ranges.MAX_UNIT - 1, ranges.MAX_UNIT]


SETS = ["4", "1-3", "2,4-9", "1-20", "10,12,14", "3-5,9-11,30", None]


def test_interval_algebra(spark):
    """Set operations against Python's sets, for every pair."""
    pairs = [(a, b) for a in SETS[:-1] for b in SETS]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = intervals_of(F.col("a")), intervals_of(F.col("b"))
    n = F.lit(4)
    rows = df.select(
        "a", "b",
        ranges.united(a, b).alias("both"),
        ranges.without(a, b).alias("less"),
        ranges.with_context(b, a).alias("context"),
        ranges.first_units(a, n).alias("first"),
        ranges.first_units(a, F.lit(None).cast("int")).alias("all"),
        ranges.first_units(a, F.lit(0)).alias("none"),
        ranges.nth_unit(a, n).alias("fourth"),
        ranges.count_units(a).alias("n"),
        ranges.range_name(a).alias("name"),
        ranges.range_key(a).alias("key"),
        ranges.name_intervals(ranges.range_name(a)).alias("named"),
    ).collect()
    for r in rows:
        x, y = GOOD_SETS[r.a], GOOD_SETS.get(r.b, [])
        assert listed(r.both) == sorted({*x, *y}) == listed(r.context)
        assert listed(r.less) == sorted({*x} - {*y})
        for got in (r.both, r.less, r.first):
            assert [i.before for i in got] == [sum(j.hi - j.lo + 1 for j in got[:k]) for k in range(len(got))]
        assert listed(r.first) == x[:4] and listed(r.all) == x and r.none is None
        assert r.fourth == (x[3] if len(x) > 3 else None) and r.n == len(x)
        assert r.name == "_".join(map(str, x)) and listed(r.named) == x
    assert {r.key for r in rows} == {"4", "1-3", "2_4-9", "1-20", "10_12_14", "3-5_9-11_30"}


GOOD_SETS = {
    "4": [4], "1-3": [1, 2, 3], "2,4-9": [2, 4, 5, 6, 7, 8, 9], "1-20": list(range(1, 21)),
    "10,12,14": [10, 12, 14], "3-5,9-11,30": [3, 4, 5, 9, 10, 11, 30],
}


def test_long_sets_have_no_name_but_a_key(column):
    long = [f"1-{10**12}", "1-127", "1000000-1000040", "5-60"]
    assert column(long, lambda x: ranges.range_key(intervals_of(x))) == long
    names = column(long, lambda x: ranges.range_name(intervals_of(x)))
    assert names[:3] == [None] * 3 and names[3].startswith("5_6_7") and names[3].endswith("_60")
    assert column(["5_x", "", "0", "5_", "7_7_8", None], lambda x: ranges.interval_text(ranges.name_intervals(x))) == [
        None, None, None, None, "7-8", None,
    ]


@pytest.mark.parametrize(
    "n, form",
    [
        (1, "א'"), (2, "ב'"), (9, "ט'"), (10, "י'"), (20, "כ'"), (90, "צ'"), (15, 'ט"ו'),
        (16, 'ט"ז'), (42, 'מ"ב'), (94, 'צ"ד'), (115, 'קט"ו'), (116, 'קט"ז'), (101, 'ק"א'),
        (342, 'שמ"ב'), (0, None), (-5, None), (1000, None),
    ],
)
def test_numerals(column, n, form):
    assert column([n], numerals.numeral, "int") == [form]


def test_letters_round_trip(spark):
    df = spark.range(1, 1000).select("id", numerals.letters(F.col("id")).alias("l"))
    assert df.where(numerals.letters_value(F.col("l")) == F.col("id")).count() == 999
    assert df.select("l").distinct().count() == 999


def test_section_tokens(column):
    tokens = ["א", "טו", "יה", "צד", "12", "05", "0", "", "ך", "דצ", "אב", "x"]
    # only canonical spellings and plain digits name a section
    assert column(tokens, numerals.section_number) == [
        1, 15, None, 94, 12, None, None, None, None, None, None, None,
    ]


def test_clean_markup(column):
    raw = [
        '<p class="x">one <em lang=he>אחת</em>&nbsp;<sup>1</sup> &quot;two&quot;</p>',
        "&lt;b&gt;",
        "a<br>b",
        "x  y\x1cz\n",
        "&nbsp;&notit;&#1488;&#x5d1; &unknown; &amp;amp;",
        None,
        "<a\nhref='x'>",
    ]
    assert column(raw, text.clean_markup) == [
        'one אחת 1 "two"',
        "<b>",
        "ab",
        "x y z",
        " ".join(html.unescape("&nbsp;&notit;&#1488;&#x5d1; &unknown; &amp;amp;").split()),
        "",
        "",
    ]


def test_word_count(column):
    words = ["", " ", "a", " a  b c\n", "one two", None]
    assert column(words, text.word_count) == [len((w or "").split()) for w in words]


def test_estimates(spark):
    row = spark.range(1).select(
        text.token_estimate(F.lit(7)).alias("t"),
        text.speech_cost(F.lit(1500)).alias("c"),
        text.pcm_seconds(F.encode(F.repeat(F.lit("x"), F.lit(96000)), "UTF-8")).alias("s"),
        text.size_mb(F.repeat(F.lit("x"), F.lit(1048576))).alias("m"),
    ).first()
    assert (row.t, row.c, row.s, row.m) == (12, 0.27, 2.0, 1.0)


def test_fenced_block(column):
    raw = ["a\n```text\n one\ntwo \n```\n```text\nlater\n```", "none", "```text\nopen"]
    assert column(raw, text.fenced_block) == ["one\ntwo", None, None]


def test_nested_payloads(column):
    raw = [
        '["a",["b",["c"]],"","<b>d</b>"]',
        '["a",[["b",{"x":["no"]}],5,null,"[1]"],["c\\"]["]]',
        '"alone"',
        '{"a": 1}',
        "[broken",
        None,
        "[]",
        '["&lt;i&gt; &amp; x", "<p> </p>"]',
    ]
    assert column(raw, payloads.flatten_payload) == [
        ["a", "b", "c", "", "<b>d</b>"],
        ["a", "b", "[1]", 'c"]['],
        ["alone"],
        [],
        [],
        [],
        [],
        ["&lt;i&gt; &amp; x", "<p> </p>"],
    ]
    cleaned = column(raw, lambda x: payloads.clean_segments(payloads.flatten_payload(x)))
    assert cleaned[0] == ["a", "b", "c", "d"]
    assert cleaned[7] == ["<i> & x"]


def test_deep_nesting(column):
    assert column(["[" * 60 + '"x"' + "]" * 60], payloads.flatten_payload) == [["x"]]


def test_first_version_of_the_language_decides(column):
    def pick(x):
        return payloads.nested_strings(payloads.pick_version(x), payloads.json_depth(x))

    raw = [
        '{"versions":[{"language":"en","text":["no"]},{"language":"he","text":["a",["b"]]}]}',
        '{"versions":[{"language":"he"},{"language":"he","text":["late"]}]}',
        '{"versions":[]}',
        "{}",
    ]
    assert column(raw, pick) == [["a", "b"], [], [], []]


def test_refs(spark):
    df = spark.createDataFrame(
        [
            ("Shulchan Arukh, Yoreh De'ah 94:3", 94, 3),
            ("Shulchan Arukh, Yoreh De'ah 95:1", 94, None),
            ("Shulchan Arukh, Yoreh De'ah 94:1:2", 94, 1),
            ("Shulchan Arukh, Yoreh De'ah 94:3-5", 94, 3),
            ("Shulchan Arukh, Yoreh De'ah 94", 94, None),
            ("see Shulchan Arukh, Yoreh De'ah 94:x, Shulchan Arukh, Yoreh De'ah 94:7", 94, 7),
        ],
        "ref string, unit int, want int",
    )
    got = df.select(
        "want", refs.base_section(F.col("ref"), F.lit("Yoreh De'ah"), F.col("unit")).alias("got")
    )
    assert all(r.want == r.got for r in got.collect())
    built = refs.build_ref(F.lit("Tur, Yoreh De'ah"), F.lit(94))
    assert spark.range(1).select(built).first()[0] == "Tur,_Yoreh_De'ah.94"


def test_template_values_with_braces_stay(spark):
    filled = templates.fill("{a}-{b}!", a=F.lit("{b}"), b=F.lit("x"))
    assert spark.range(1).select(filled).first()[0] == "{b}-x!"
    with pytest.raises(KeyError):
        templates.fill("{missing}")


def test_polish_prompt(spark):
    df = spark.createDataFrame([("d", None), ("d", ""), ("d", "r")], "d string, r string")
    got = [
        r[0] for r in df.select(templates.polish_prompt(F.col("d"), F.col("r"))).collect()
    ]
    assert got[:2] == ["d", "d"]
    assert got[2].index("\nr\n\n") < got[2].index(":\nd") and got[2].endswith("\nd")
