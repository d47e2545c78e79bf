"""Corpora, works and authorities: small dimensions known when a plan is built.

They are Python values so that the pattern of each authority becomes a literal
in the plan (compiled once per task) and every lookup is either such a literal
or an equi join on ``corpus`` against a local relation of a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- fixed values: names and formats that results must reproduce -----------

BASE_WORK = "Shulchan Arukh"
CORE_WORKS = ("Tur", "Shulchan Arukh")
COMMON_WORKS = ("Tur", "Beit Yosef", "Shulchan Arukh")
ALWAYS_REQUIRED = "Mechaber"
GLOSS_AUTHORITY = "Rema"
GLOSS_MARKER = "הגה"
WHOLE_DRAFT_AUTHORITIES = ("Tur", "Beit Yosef")

COMMON_PATTERNS = {
    "Tur": r"(טור|הטור|בעל הטורים)",
    "Beit Yosef": r"(בית יוסף|ב[״\"׳']י|הבית יוסף)",
    "Mechaber": (
        r"(מחבר|שולחן ערוך|השולחן ערוך|ש[ו״\"׳']{1,2}ע|הש[ו״\"׳']{1,2}ע|מרן|המחבר)"
    ),
    "Rema": (
        r"(רמ[״\"׳']א|הרמ[״\"׳']א|רמ[״\"׳']א בהגה|הגה|הגהת הרמ[״\"׳']א|הגהות הרמ[״\"׳']א)"
    ),
}

# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Authority:
    """A commentator: how links name it and how drafts mention it."""

    name: str
    ref_prefix: str
    pattern: str


@dataclass(frozen=True)
class Corpus:
    """One corpus: its names, its linked authorities and its prompt slots."""

    key: str
    slug: str
    native_name: str
    linked: tuple[Authority, ...]
    slots: dict[str, str] = field(default_factory=dict)
    common_patterns: dict[str, str] = field(default_factory=lambda: dict(COMMON_PATTERNS))

    @property
    def base_prefix(self) -> str:
        return f"{BASE_WORK}, {self.key}"

    @property
    def work_refs(self) -> dict[str, str]:
        """Work name to reference prefix, in document order."""
        refs = {work: f"{work}, {self.key}" for work in COMMON_WORKS}
        refs.update({a.name: a.ref_prefix for a in self.linked})
        return refs

    @property
    def patterns(self) -> dict[str, str]:
        return {**self.common_patterns, **{a.name: a.pattern for a in self.linked}}


# --- fixed values: the two corpora ------------------------------------------

YOREH_DEAH = Corpus(
    key="Yoreh De'ah",
    slug="Yoreh_Deah",
    native_name="יורה דעה",
    linked=(
        Authority(
            "Shach",
            "Siftei Kohen on Shulchan Arukh, Yoreh De'ah",
            r"(ש[״\"׳']ך|הש[״\"׳']ך|שפתי כהן)",
        ),
        Authority(
            "Taz",
            "Turei Zahav on Shulchan Arukh, Yoreh De'ah",
            r"(ט[״\"׳']ז|הט[״\"׳']ז|טורי זהב)",
        ),
    ),
    slots={
        "hebrew_name": "יורה דעה",
        "commentators_list_hebrew": 'הטור, בית יוסף, שולחן ערוך, רמ"א, ש"ך וט"ז',
        "commentators_list_short": 'הטור, בית יוסף, מחבר, רמ"א, ש"ך וט"ז',
        "prompt_commentators_desc": (
            'השפתי כהן (הש"ך) והטורי זהב (הט"ז) והמקורות שהם מביאים'
        ),
        "tts_abbreviations": (
            '"רמ"א" -> "הרמ"א", "ש"ך" -> "הש"ך", "ט"ז" -> "הט"ז", "מהרש"ל" -> "המהרש"ל"'
        ),
    },
)

ORACH_CHAYIM = Corpus(
    key="Orach Chayim",
    slug="Orach_Chayim",
    native_name="אורח חיים",
    linked=(
        Authority(
            "Magen Avraham", "Magen Avraham", r"(מגן אברהם|מג[״\"׳']א|המגן אברהם)"
        ),
        Authority(
            "Taz",
            "Turei Zahav on Shulchan Arukh, Orach Chayim",
            r"(ט[״\"׳']ז|הט[״\"׳']ז|טורי זהב)",
        ),
        Authority(
            "Mishna Berura", "Mishnah Berurah", r"(משנה ברורה|מ[״\"׳']ב|המשנה ברורה)"
        ),
    ),
    slots={
        "hebrew_name": "אורח חיים",
        "commentators_list_hebrew": (
            'הטור, בית יוסף, שולחן ערוך, רמ"א, מגן אברהם, טורי זהב ומשנה ברורה'
        ),
        "commentators_list_short": (
            'הטור, בית יוסף, מחבר, רמ"א, מגן אברהם, טורי זהב ומשנה ברורה'
        ),
        "prompt_commentators_desc": (
            'המגן אברהם (המג"א), הטורי זהב (הט"ז) והמשנה ברורה (המשנ"ב) והמקורות שהם מביאים'
        ),
        "tts_abbreviations": (
            '"רמ"א" -> "הרמ"א", "מג"א" -> "המגן אברהם", "ט"ז" -> "הט"ז", '
            '"מ"ב" -> "המשנה ברורה"'
        ),
    },
)

# --- end of fixed values ----------------------------------------------------

CORPORA: tuple[Corpus, ...] = (YOREH_DEAH, ORACH_CHAYIM)


def _local(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A local relation: its size is known to the planner, so Spark itself
    decides to broadcast it."""
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def works_table(spark: SparkSession, corpora: tuple[Corpus, ...] = CORPORA) -> DataFrame:
    """``works(corpus, work, ref_prefix, work_ord, is_core)``, one row per work."""
    return _local(
        spark,
        [
            {
                "corpus": corpus.key,
                "work": work,
                "ref_prefix": prefix,
                "work_ord": ord_,
                "is_core": work in CORE_WORKS,
            }
            for corpus in corpora
            for ord_, (work, prefix) in enumerate(corpus.work_refs.items(), 1)
        ],
    )


def authorities_table(spark: SparkSession, corpora: tuple[Corpus, ...] = CORPORA) -> DataFrame:
    """``authorities(corpus, authority, ref_prefix)`` for the authorities that links name."""
    return _local(
        spark,
        [
            {"corpus": c.key, "authority": a.name, "ref_prefix": a.ref_prefix}
            for c in corpora
            for a in c.linked
        ],
    )


def slots_table(spark: SparkSession, corpora: tuple[Corpus, ...] = CORPORA) -> DataFrame:
    """``slots(corpus, slug, <one column per prompt slot>)``."""
    return _local(spark, [{"corpus": c.key, "slug": c.slug, **c.slots} for c in corpora])
