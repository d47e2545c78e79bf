"""Coverage audit: does each section of a draft mention who it must mention?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.dimensions import (
    ALWAYS_REQUIRED,
    CORPORA,
    GLOSS_AUTHORITY,
    GLOSS_MARKER,
    WHOLE_DRAFT_AUTHORITIES,
    Corpus,
)
from corpusweave.functions.binding import let, settle
from corpusweave.functions.numerals import MAX_NUMERAL, letters
from corpusweave.operators.blocks import section_blocks
from corpusweave.operators.links import (
    authority_names,
    match_authorities,
    orient_links,
    required_bits,
)

# --- fixed values: report wording -------------------------------------------

LINE = "=" * 60
TITLE = "      LOCALIZED HEURISTIC EVALUATION FOR SIMAN %s"
SECTIONS_TITLE = "--- SE'IF-BY-SE'IF LOCALIZED COMMENTATOR COVERAGE CHECK ---"
SECTION_TITLE = "\n[סעיף %s] (Se'if %d)"
NO_BLOCK = "  ⚠️ Draft has no section block for this Se'if!"
ACTIVE = "  Commentators active in {source} source: %s"
MENTION = "    - %-12s: %-3d mentions %s"
WHOLE_TITLE = "\n--- GENERAL DRAFT COVERAGE CHECK ---"
WHOLE_MENTION = "  - %-12s: %-3d mentions %s"
PASS = "[PASS]"
WARN = "[WARN] (Missing!)"
WHOLE_WARN = "[WARN] (Missing from entire draft!)"
SUMMARY = "--- FINAL SUMMARY REPORT ---"
LOCAL_TOTAL = "Total Localized Omission Flags: %d"
GENERAL_TOTAL = "Total General Omission Flags:   %d"
MISSING_BLOCKS = "Missing Se'ifim blocks:        [%s]"
EXCELLENT = "Status: EXCELLENT (100% Localized Heuristic Coverage Pass)"
WARNING = "Status: WARNING (%d issues identified)"
ACTION = (
    "Action: Please review the flagged items where active commentators were not mentioned "
    "in their corresponding Se'if draft block or globally."
)
NO_BASE_TEXT = "Error: Shulchan Arukh text was not found for this Siman in {source}."
FETCHING = "Fetching raw Hebrew sources from {source} API..."
LINKS = "Fetched %d cross-reference links from {source}."
FETCHED = "Fetch complete.\n"

# --- end of fixed values ----------------------------------------------------

TOO_MANY_SECTIONS = f"Error: more than {MAX_NUMERAL} sections."

UNKNOWN_CORPUS = "Error: the corpus of this draft is not known."


def _counts(text: Column, patterns: list[str | None]) -> Column:
    """Non-overlapping, case-insensitive mentions, one number per pattern."""
    return F.array(
        *[F.lit(0) if p is None else F.regexp_count(text, F.lit(f"(?iu){p}")) for p in patterns]
    )


def _of_corpus(corpus: Column, corpora: tuple[Corpus, ...], value) -> Column:
    """``value(corpus)`` of the corpus at hand; null for an unknown one."""
    found = F.lit(None)
    for c in corpora:
        found = F.when(corpus == c.key, value(c)).otherwise(found)
    return found


def _draft_rows(drafts: DataFrame, corpora: tuple[Corpus, ...], names: tuple[str, ...]) -> DataFrame:
    """Drafts with the mentions of each section block (``cells``) and of the whole text.

    Everything about the text is worked out next to the scan; the text itself
    does not leave the task.  The patterns are literals of the plan: each is
    compiled once per task.
    """
    others = [c for c in drafts.columns if c != "text"]
    texts = drafts.select(*others, F.coalesce("text", F.lit("")).alias("text"))
    blocks = settle(texts, blocks=section_blocks(F.col("text")))

    def cells(c: Corpus) -> Column:
        in_sections = {ALWAYS_REQUIRED, GLOSS_AUTHORITY, *(a.name for a in c.linked)}
        patterns = [c.patterns[n] if n in in_sections else None for n in names]
        return F.transform(
            "blocks",
            lambda b: F.struct(
                b.section.cast("int").alias("section"),
                (b.text == "").alias("is_empty"),
                _counts(b.text, patterns).alias("counts"),
            ),
        )

    def whole(c: Corpus) -> Column:
        return _counts(F.col("text"), [c.patterns[n] for n in WHOLE_DRAFT_AUTHORITIES])

    return blocks.select(
        *others,
        _of_corpus(F.col("corpus"), corpora, cells).alias("cells"),
        _of_corpus(F.col("corpus"), corpora, whole).alias("whole"),
    )


def _status(count: Column, warning: str) -> Column:
    return F.when(count > 0, PASS).otherwise(warning)


def audit_drafts(
    drafts: DataFrame,
    base: DataFrame,
    links: DataFrame,
    authorities: DataFrame,
    corpora: tuple[Corpus, ...] = CORPORA,
    gloss_marker: str = GLOSS_MARKER,
    source_name: str = "the library",
) -> DataFrame:
    """Audit every draft in one job.

    In: ``drafts(corpus, unit, text, …)``, any number per unit; ``base(corpus,
    unit, section, text)``, the numbered base text; ``links(corpus, unit, ref,
    anchor_ref)``.  Out, per draft: its columns other than the text (``corpus``,
    ``unit``, what tells drafts of a unit apart), ``success``, ``local_flags``,
    ``general_flags``, ``missing`` (ordered section numbers), ``report``.

    A section without a block is one flag, whoever it requires; otherwise each
    required authority that the block never mentions is one.  Authorities of
    the whole draft are looked for in the whole draft.  A draft whose corpus is
    not known, whose unit has no base text, or more sections than numerals
    reach, is not a success and says so in its report.

    Drafts and base texts are never shuffled.  What a unit requires becomes one
    row of at most 999 sections and their bitmaps; each draft joins that row
    and is judged inside its own.
    """
    names = authority_names(corpora)
    matched = match_authorities(orient_links(links), authorities)
    required = required_bits(base, matched, names, gloss_marker)
    listed = F.when(F.col("section") <= MAX_NUMERAL, F.struct("section", "bits"))
    per_unit = required.groupBy("corpus", "unit").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sort_array(F.collect_list(listed)).alias("required")
    )
    link_counts = links.groupBy("corpus", "unit").agg(F.count(F.lit(1)).alias("n_links"))
    others = [c for c in drafts.columns if c != "text"]
    joined = (
        _draft_rows(drafts, corpora, names)
        .join(per_unit, ["corpus", "unit"], "left")
        .join(link_counts, ["corpus", "unit"], "left")
    )

    def judged(r):
        cell = F.get(F.filter("cells", lambda c: c.section == r.section), F.lit(0))
        return let(
            cell,
            lambda c: F.struct(
                r.section.cast("int").alias("section"),
                F.coalesce(c.is_empty, F.lit(True)).alias("no_block"),
                F.array_compact(
                    F.array(
                        *[
                            F.when(
                                F.getbit(r.bits, F.lit(i)) == 1,
                                F.struct(
                                    F.lit(name).alias("authority"),
                                    F.coalesce(F.get(c.counts, F.lit(i)), F.lit(0)).alias("count"),
                                ),
                            )
                            for i, name in enumerate(names)
                        ]
                    )
                ).alias("checks"),
            ),
        )

    sections = settle(joined, sections=F.transform("required", judged))

    def flags(s):
        unmentioned = F.size(F.filter(s.checks, lambda c: c["count"] == 0))
        return F.when(s.no_block, 1).otherwise(unmentioned)

    def lines(s):
        title = F.format_string(SECTION_TITLE, letters(s.section), s.section)
        active = F.format_string(
            ACTIVE.format(source=source_name),
            F.array_join(F.transform(s.checks, lambda c: c.authority), ", "),
        )
        mentions = F.transform(
            s.checks,
            lambda c: F.format_string(MENTION, c.authority, c["count"], _status(c["count"], WARN)),
        )
        said = F.concat_ws("\n", title, active, F.array_join(mentions, "\n"))
        return F.when(s.no_block, F.concat_ws("\n", title, F.lit(NO_BLOCK))).otherwise(said)

    counted = sections.select(
        *others,
        F.coalesce("n_sections", F.lit(0)).alias("n_sections"),
        "n_links",
        F.aggregate(
            F.coalesce(F.transform("sections", flags), F.array().cast("array<int>")),
            F.lit(0).cast("bigint"),
            lambda total, n: total + n,
        ).alias("local"),
        F.transform(F.filter("sections", lambda s: s.no_block), lambda s: s.section).alias("missing"),
        F.array_join(F.transform("sections", lines), "\n").alias("body"),
        *[F.get("whole", F.lit(i)).alias(f"whole_{i}") for i in range(len(WHOLE_DRAFT_AUTHORITIES))],
        F.col("whole").isNull().alias("is_unknown"),
    )
    return _conclude(counted, others, source_name)


def _conclude(per_draft: DataFrame, others: list[str], source_name: str) -> DataFrame:
    whole_counts = [F.col(f"whole_{i}") for i in range(len(WHOLE_DRAFT_AUTHORITIES))]
    general = sum(
        (F.when(c > 0, 0).otherwise(1) for c in whole_counts), start=F.lit(0)
    )
    error = (
        F.when(F.col("is_unknown"), UNKNOWN_CORPUS)
        .when(F.col("n_sections") == 0, NO_BASE_TEXT.format(source=source_name))
        .when(F.col("n_sections") > MAX_NUMERAL, TOO_MANY_SECTIONS)
    )
    flagged = per_draft.select(
        "*",
        error.alias("error"),
        general.alias("general"),
        (F.col("local") + general).alias("total"),
    )
    ok = F.col("error").isNull()
    success = ok & (F.col("total") == 0)
    report = F.concat_ws(
        "\n",
        F.lit(LINE),
        F.format_string(TITLE, F.col("unit").cast("string")),
        F.lit(LINE + "\n"),
        F.lit(FETCHING.format(source=source_name)),
        F.format_string(
            LINKS.format(source=source_name), F.coalesce("n_links", F.lit(0).cast("bigint"))
        ),
        F.lit(FETCHED),
        F.lit(SECTIONS_TITLE),
        F.col("body"),
        F.lit(WHOLE_TITLE),
        *[
            F.format_string(WHOLE_MENTION, F.lit(a), c, _status(c, WHOLE_WARN))
            for a, c in zip(WHOLE_DRAFT_AUTHORITIES, whole_counts)
        ],
        F.lit("\n" + LINE),
        F.lit(SUMMARY),
        F.format_string(LOCAL_TOTAL, F.col("local")),
        F.format_string(GENERAL_TOTAL, F.col("general")),
        F.when(
            F.size("missing") > 0,
            F.format_string(
                MISSING_BLOCKS,
                F.array_join(F.transform("missing", lambda m: m.cast("string")), ", "),
            ),
        ),
        F.when(success, EXCELLENT).otherwise(
            F.concat(F.format_string(WARNING, F.col("total")), F.lit("\n" + ACTION))
        ),
        F.lit(LINE),
    )
    return flagged.select(
        *others,
        success.alias("success"),
        F.when(ok, F.col("local")).otherwise(0).cast("bigint").alias("local_flags"),
        F.when(ok, F.col("general")).otherwise(0).cast("bigint").alias("general_flags"),
        F.when(ok, F.col("missing"))
        .otherwise(F.array().cast("array<int>"))
        .alias("missing"),
        F.coalesce("error", report).alias("report"),
    )
