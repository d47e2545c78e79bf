import pytest
from pyspark.sql import functions as F

from corpusweave.dimensions import CORPORA, YOREH_DEAH, authorities_table
from corpusweave.operators.audit import audit_drafts
from corpusweave.operators.blocks import split_blocks
from corpusweave.operators.links import match_authorities, orient_links, required_authorities

YD = YOREH_DEAH.key
DRAFT = "corpus string, unit int, text string"
BASE = "corpus string, unit int, section int, text string"
LINK = "corpus string, unit int, ref string, anchor_ref string"


def base_ref(unit, rest):
    return f"Shulchan Arukh, {YD} {unit}:{rest}"


def shach(unit, rest):
    return f"Siftei Kohen on Shulchan Arukh, {YD} {unit}:{rest}"


def taz(unit, rest):
    return f"Turei Zahav on Shulchan Arukh, {YD} {unit}:{rest}"


def blocks(spark, text):
    df = spark.createDataFrame([(YD, 1, text)], DRAFT)
    return {r.section: r.text for r in split_blocks(df).collect()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("intro\n## סעיף א\none\n## סעיף ב\ntwo", {1: "\none\n", 2: "\ntwo"}),
        ("## סעיף 12 (x)\nA", {12: " (x)\nA"}),
        ("### בסעיף ('ג') rest", {3: " rest"}),
        # an inner quote ends the token: the quoted 15 reads as 9
        ('## סעיף ט"ו x', {9: "ו x"}),
        ("## סעיף א 1 ## סעיף פתיחה 2 ## סעיף ב 3", {1: " 1 ", 2: " 3"}),
        ("## סעיף א old ## סעיף ב b ## סעיף א new", {1: " new", 2: " b "}),
        ("## סעיף א## סעיף ב b", {1: "", 2: " b"}),
        ("## סעיף 05 x", {}),
        ("##סעיף א x", {}),
        ("", {}),
    ],
)
def test_blocks(spark, text, want):
    assert blocks(spark, text) == want


def test_block_round_trip(spark):
    from corpusweave.functions.numerals import letters

    numbers = spark.range(1, 1000).select("id", letters(F.col("id")).alias("l")).collect()
    text = "".join(f"## סעיף {r.l}\n{r.id}\n" for r in numbers)
    assert blocks(spark, text) == {r.id: f"\n{r.id}\n" for r in numbers}


def test_link_orientation(spark):
    rows = [
        (YD, 94, shach(94, "1:1"), base_ref(94, "1")),
        (YD, 94, base_ref(94, "2"), taz(94, "2:1")),
        (YD, 94, base_ref(94, "3"), base_ref(94, "1")),
        (YD, 94, base_ref(95, "1"), taz(95, "1:1")),
        (YD, 94, base_ref(94, "1"), None),
        (YD, 94, base_ref(94, "1"), ""),
        (YD, 94, "Genesis 1:1", taz(94, "1")),
        (YD, 94, None, None),
        (YD, 94, base_ref(94, "0"), taz(94, "1")),
    ]
    got = orient_links(spark.createDataFrame(rows, LINK)).collect()
    assert sorted((r.section, r.other_ref) for r in got) == [
        (1, shach(94, "1:1")), (2, taz(94, "2:1")), (3, base_ref(94, "1")),
    ]


def test_required(spark):
    base = spark.createDataFrame(
        [(YD, 94, 1, "דין"), (YD, 94, 2, "הגה דין"), (YD, 95, 1, "")], BASE
    )
    links = spark.createDataFrame(
        [
            (YD, 94, shach(94, "1:1"), base_ref(94, "1")),
            (YD, 94, shach(94, "1:2"), base_ref(94, "1")),
            (YD, 94, "quoted in " + taz(94, "1"), base_ref(94, "1:2")),
            (YD, 94, taz(94, "3"), base_ref(94, "3")),
            (YD, 96, taz(96, "1"), base_ref(96, "1")),
        ],
        LINK,
    )
    matched = match_authorities(orient_links(links), authorities_table(spark))
    got = {
        (r.unit, r.section): r.required for r in required_authorities(base, matched).collect()
    }
    assert got == {
        (94, 1): ["Mechaber", "Shach", "Taz"],
        (94, 2): ["Mechaber", "Rema"],
        (95, 1): ["Mechaber"],
    }


GOOD = """
# סימן צד
פתיחה: שורש העניין נמצא בטור, ומשם לקח אותו הבית יוסף.

## סעיף א
כאן המחבר מקל לגמרי. אין חולק עליו: כך הבין גם הש"ך, ובסוף דבריו חוזר השפתי כהן ומחזק זאת.

## סעיף ב
שני צדדים לדבר. המחבר מקל, הרמ"א מחמיר בכלי ישן, ולפי הט"ז אפשר לסמוך בשעת הדחק.

## סעיף ג
נשאר פרט אחרון שהמחבר אינו מאריך בו.
"""
POOR = "\n## סעיף א\nכאן רק המחבר נזכר, בלי שאר הדעות.\n"


@pytest.fixture(scope="module")
def audited(spark):
    drafts = spark.createDataFrame(
        [
            (YD, 94, GOOD),
            (YD, 95, POOR),
            (YD, 96, GOOD),
            (YD, 97, "## סעיף א## סעיף ב \n"),
            (YD, 98, "x"),
            (YD, 99, None),
        ],
        DRAFT,
    )
    base = spark.createDataFrame(
        [
            (YD, 94, 1, "דין כלשהו"),
            (YD, 94, 2, "הגה דין נוסף"),
            (YD, 94, 3, "דין שלישי"),
            (YD, 95, 1, "דין כלשהו"),
            (YD, 95, 2, "הגה דין נוסף"),
            (YD, 97, 1, "א"),
            (YD, 97, 2, "ב"),
            (YD, 93, 1, "no draft"),
            (YD, 99, 1, None),
            *[(YD, 98, n, "x") for n in range(1, 1001)],
        ],
        BASE,
    )
    links = spark.createDataFrame(
        [
            (YD, 94, shach(94, "1:1"), base_ref(94, "1")),
            (YD, 94, taz(94, "2:1"), base_ref(94, "2")),
            (YD, 95, shach(95, "1:1"), base_ref(95, "1")),
            (YD, 92, shach(92, "1:1"), base_ref(92, "1")),
        ],
        LINK,
    )
    result = audit_drafts(drafts, base, links, authorities_table(spark), CORPORA)
    return {r.unit: r for r in result.collect()}


def test_only_drafts_are_audited(audited):
    assert set(audited) == {94, 95, 96, 97, 98, 99}


def test_draft_without_text_misses_everything(audited):
    assert (audited[99].missing, audited[99].general_flags) == ([1], 2)


def test_good_draft(audited):
    r = audited[94]
    assert (r.success, r.local_flags, r.general_flags, r.missing) == (True, 0, 0, [])
    assert "Status: EXCELLENT" in r.report
    assert "    - Shach       : 2   mentions [PASS]" in r.report
    assert "Fetched 2 cross-reference links" in r.report


def test_poor_draft(audited):
    r = audited[95]
    # one authority missing in section 1, and section 2 has no block at all
    assert (r.success, r.local_flags, r.general_flags, r.missing) == (False, 2, 2, [2])
    assert "Status: WARNING (4 issues identified)" in r.report
    assert "Missing Se'ifim blocks:        [2]" in r.report
    assert "    - Shach       : 0   mentions [WARN] (Missing!)" in r.report
    lines = r.report.split("\n")
    assert lines[lines.index("[סעיף ב] (Se'if 2)") + 1] == (
        "  ⚠️ Draft has no section block for this Se'if!"
    )


def test_draft_without_base_text(audited):
    r = audited[96]
    assert (r.success, r.local_flags, r.general_flags, r.missing) == (False, 0, 0, [])
    assert r.report.startswith("Error: Shulchan Arukh text was not found")


def test_empty_block_is_missing_and_blank_block_is_not(audited):
    # section 2 holds only white space: present, but mentions nobody
    assert audited[97].missing == [1]
    assert audited[97].local_flags == 2


def test_too_many_sections(audited):
    r = audited[98]
    assert r.success is False and r.missing == [] and "999" in r.report


def test_empty_inputs(spark):
    result = audit_drafts(
        spark.createDataFrame([], DRAFT),
        spark.createDataFrame([], BASE),
        spark.createDataFrame([], LINK),
        authorities_table(spark),
    )
    assert result.collect() == []


def test_drafts_of_a_unit_are_told_apart(spark):
    """Two models, and the same draft twice; a corpus nobody knows gets an error row."""
    drafts = spark.createDataFrame(
        [
            (YD, 94, "a", GOOD), (YD, 94, "b", POOR), (YD, 94, "b", POOR),
            ("Nowhere", 94, "a", GOOD), (None, 94, "a", GOOD),
        ],
        "corpus string, unit int, model string, text string",
    )
    base = spark.createDataFrame([(YD, 94, 1, "x"), (YD, 94, 2, "y"), ("Nowhere", 94, 1, "z")], BASE)
    links = spark.createDataFrame([(YD, 94, shach(94, "1:1"), base_ref(94, "1"))], LINK)
    rows = audit_drafts(drafts, base, links, authorities_table(spark)).collect()
    got = sorted((str(r.corpus), r.model, r.success, r.local_flags, tuple(r.missing)) for r in rows)
    assert got == [
        ("None", "a", False, 0, ()), ("Nowhere", "a", False, 0, ()), (YD, "a", True, 0, ()),
        (YD, "b", False, 2, (2,)), (YD, "b", False, 2, (2,)),
    ]
    assert sum("corpus of this draft is not known" in r.report for r in rows) == 2


def test_base_sections_are_not_aggregated(spark):
    """Links are reduced to bitmaps on their own side; base sections only join them."""
    empty = spark.createDataFrame
    matched = match_authorities(orient_links(empty([], LINK)), authorities_table(spark))
    plan = required_authorities(empty([], BASE), matched)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "collect_set" not in plan and "ObjectHashAggregate" not in plan
