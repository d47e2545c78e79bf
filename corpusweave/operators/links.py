"""Links between the base text and its commentators, and what they require."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.dimensions import (
    ALWAYS_REQUIRED,
    BASE_WORK,
    CORPORA,
    GLOSS_AUTHORITY,
    GLOSS_MARKER,
    Corpus,
)
from corpusweave.functions.binding import settle
from corpusweave.functions.refs import base_section


def orient_links(links: DataFrame) -> DataFrame:
    """Put the base-text end of each link first and read its section.

    ``links(corpus, unit, ref, anchor_ref, …)`` gains ``base_ref``,
    ``other_ref`` and ``section``.  When both ends are base text ``ref`` is the
    base end.  Links without a base end, without another end, or without a
    section of the unit are dropped.  Whether the section exists is settled
    where sections are counted, see :func:`required_authorities`.
    """
    prefix = F.concat(F.lit(f"{BASE_WORK}, "), F.col("corpus"))
    ref = F.coalesce("ref", F.lit(""))
    anchor = F.coalesce("anchor_ref", F.lit(""))
    ends = settle(
        links,
        base_ref=F.when(F.startswith(ref, prefix), ref).when(
            F.startswith(anchor, prefix), anchor
        ),
        other_ref=F.when(F.startswith(ref, prefix), anchor).when(
            F.startswith(anchor, prefix), ref
        ),
    ).where((F.col("base_ref") != "") & (F.col("other_ref") != ""))
    return settle(
        ends, section=base_section(F.col("base_ref"), F.col("corpus"), F.col("unit"))
    ).where(F.col("section") >= 1)


def match_authorities(oriented: DataFrame, authorities: DataFrame) -> DataFrame:
    """Authorities whose reference prefix occurs in the other end of a link.

    The join is an equi join on the corpus with the containment as its
    residual, so a link meets only the few authorities of its own corpus.
    """
    a = authorities.alias("a")
    link = oriented.alias("l")
    return link.join(
        a,
        (F.col("l.corpus") == F.col("a.corpus"))
        & F.contains(F.col("l.other_ref"), F.col("a.ref_prefix")),
    ).select("l.*", "a.authority")


def authority_names(corpora: tuple[Corpus, ...] = CORPORA) -> tuple[str, ...]:
    """All authorities a section can require, in order: the place of a name is its bit."""
    linked = {a.name for c in corpora for a in c.linked}
    return tuple(sorted({ALWAYS_REQUIRED, GLOSS_AUTHORITY, *linked}))


def authorities_of(bits: Column, names: tuple[str, ...]) -> Column:
    """Names of the set bits, in order."""
    named = [F.when(F.getbit(bits, F.lit(i)) == 1, name) for i, name in enumerate(names)]
    return F.array_compact(F.array(*named))


def required_bits(
    base: DataFrame,
    matched: DataFrame,
    names: tuple[str, ...],
    gloss_marker: str = GLOSS_MARKER,
) -> DataFrame:
    """``(corpus, unit, section, bits)``: what each section of the base text requires, as a bitmap.

    ``base(corpus, unit, section, text)`` has one row per section.  Required are
    the linked authorities, one in every section, and one where the gloss
    marker occurs.  Links alone are aggregated, by ``bit_or`` on their own side
    first; base sections join their bitmap.  A link to a section the base text
    lacks finds nothing to join.
    """
    place = F.lit(None).cast("int")
    for i, name in enumerate(names):
        place = F.when(F.col("authority") == name, i).otherwise(place)
    linked = (
        matched.select("corpus", "unit", "section", place.alias("_place"))
        .where("_place is not null")
        .groupBy("corpus", "unit", "section")
        .agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias("_linked"))
    )
    always, gloss = 1 << names.index(ALWAYS_REQUIRED), 1 << names.index(GLOSS_AUTHORITY)
    own = F.when(F.contains("text", F.lit(gloss_marker)), always | gloss).otherwise(always)
    return (
        base.select("corpus", "unit", "section", own.cast("bigint").alias("_own"))
        .join(linked, ["corpus", "unit", "section"], "left")
        .select(
            "corpus",
            "unit",
            "section",
            F.col("_own").bitwiseOR(F.coalesce("_linked", F.lit(0).cast("bigint"))).alias("bits"),
        )
    )


def required_authorities(
    base: DataFrame,
    matched: DataFrame,
    gloss_marker: str = GLOSS_MARKER,
    corpora: tuple[Corpus, ...] = CORPORA,
) -> DataFrame:
    """``(corpus, unit, section, required)`` with a sorted array of authorities."""
    names = authority_names(corpora)
    bits = required_bits(base, matched, names, gloss_marker)
    return bits.select(
        "corpus", "unit", "section", authorities_of(F.col("bits"), names).alias("required")
    )
