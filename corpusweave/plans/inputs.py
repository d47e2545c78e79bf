"""The given tables in the shapes the operators take.

Every shape is derived row by row, inside Spark, from whole tables:

* documents: drafts, base texts and payloads (unit = doc_id)
* conversations: segments (unit = conv_id, work by role, position = turn)
* labels: target units (quality 1) and cached artefacts
* orders: links, range specs and requests
* customer: requests over document ranges and their relations texts
* events: artefact versions and batch states
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.dimensions import BASE_WORK, CORPORA, ORACH_CHAYIM, YOREH_DEAH, Corpus
from corpusweave.functions.numerals import letters

# Patterns for the languages of the documents, in place of the built-in ones.
COMMON = {
    "Tur": "(with|avec|mit)",
    "Beit Yosef": "(from|pour|von|para)",
    "Mechaber": "(tion|ing|ung)",
    "Rema": "(ou|and|die)",
}
LINKED = {
    "Shach": "(wh|pa)",
    "Taz": "(er the|lle|lich)",
    "Magen Avraham": "(sch|os)",
    "Mishna Berura": "(keit|ent)",
}
GLOSS = "en"
# First digits of the md5 of lines that get no section in the draft of their document.
DROPPED = ("0", "1", "2", "3")


def _for_documents(corpus: Corpus) -> Corpus:
    return replace(
        corpus,
        common_patterns=COMMON,
        linked=tuple(replace(a, pattern=LINKED[a.name]) for a in corpus.linked),
    )


DOCUMENT_CORPORA = tuple(_for_documents(c) for c in CORPORA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_of(lang: Column) -> Column:
    return F.when(lang.isin("en", "fr"), YOREH_DEAH.key).otherwise(ORACH_CHAYIM.key)


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line != "")


# --- documents --------------------------------------------------------------


def document_drafts(documents: DataFrame) -> DataFrame:
    """A draft per document: its lines, each under the header of its number, but for about
    every fourth, which a hash picks."""
    section = F.transform(
        lines_of(F.col("text")),
        lambda line, i: F.when(
            ~F.left(F.md5(F.encode(line, "UTF-8")), F.lit(1)).isin(*DROPPED),
            F.concat(
                F.lit("\n## סעיף "),
                F.coalesce(letters(i + 1), (i + 1).cast("string")),
                F.lit("\n"),
                line,
            ),
        ),
    )
    kept = F.filter(section, lambda s: s.isNotNull())
    return documents.select(
        corpus_of(F.col("lang")).alias("corpus"),
        F.col("doc_id").alias("unit"),
        F.concat(F.lit("# "), "source", F.array_join(kept, "")).alias("text"),
    )


def document_sections(documents: DataFrame) -> DataFrame:
    """Base text: the numbered non-empty lines of a document."""
    return documents.select(
        corpus_of(F.col("lang")).alias("corpus"),
        F.col("doc_id").alias("unit"),
        F.posexplode(lines_of(F.col("text"))).alias("pos", "text"),
    ).select("corpus", "unit", (F.col("pos") + 1).alias("section"), "text")


def document_payloads(documents: DataFrame) -> DataFrame:
    """Nested JSON of a document: a list of lines, each a list of sentences."""
    tree = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, r"\. ", -1))
    return documents.withColumn("payload", F.to_json(tree))


def versioned_payloads(documents: DataFrame) -> DataFrame:
    """Versioned JSON of a document: its text under its own language, its source as ``en``."""
    versions = F.array(
        F.struct(F.col("lang").alias("language"), lines_of(F.col("text")).alias("text")),
        F.struct(F.lit("en").alias("language"), F.array("source").alias("text")),
    )
    return documents.withColumn("payload", F.to_json(F.struct(versions.alias("versions"))))


# --- conversations ----------------------------------------------------------

ROLE_WORKS = {"user": BASE_WORK, "system": "Tur", "assistant": "Taz"}


def unit_corpus(unit: Column) -> Column:
    """Both corpora share the conversations: even ones are of the first."""
    return F.when(unit % 2 == 0, YOREH_DEAH.key).otherwise(ORACH_CHAYIM.key)


def conversation_segments(conversations: DataFrame) -> DataFrame:
    work = F.lit(None).cast("string")
    for role, name in ROLE_WORKS.items():
        work = F.when(F.col("role") == role, name).otherwise(work)
    return conversations.select(
        unit_corpus(F.col("conv_id")).alias("corpus"),
        F.col("conv_id").alias("unit"),
        work.alias("work"),
        F.col("turn").alias("position"),
        "text",
    )


def conversation_units(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        unit_corpus(F.col("conv_id")).alias("corpus"), F.col("conv_id").alias("unit")
    ).distinct()


def target_units(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select(
        unit_corpus(F.col("doc_id")).alias("corpus"), F.col("doc_id").alias("unit")
    )


def result_lines(conversations: DataFrame) -> DataFrame:
    """Result lines of batch jobs: errors from system turns, broken lines from short turns, and
    lines that have lost their id."""
    id_ = F.concat(F.lit("siman_"), F.col("conv_id").cast("string"), F.lit("_generation"))
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    response = F.struct(
        F.lit(200).alias("status_code"),
        F.struct(F.array(message).alias("choices")).alias("body"),
    ).alias("response")
    failed = F.struct(id_.alias("custom_id"), F.struct("role").alias("error"))
    value = (
        F.when(F.length("text") < 40, F.concat(F.lit('{"custom_id": '), "text"))
        .when(F.col("role") == "system", F.to_json(failed))
        .when(F.col("turn") % 5 == 3, F.to_json(F.struct(response)))
        .otherwise(F.to_json(F.struct(id_.alias("custom_id"), response)))
    )
    return conversations.select("conv_id", "turn", value.alias("value"))


# --- orders and customers ---------------------------------------------------


def order_links(orders: DataFrame) -> DataFrame:
    """A link per order: the authority by priority, its ends by status, its section by month."""
    unit = F.col("o_custkey").cast("string")
    section = F.month("o_orderdate").cast("string")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    corpus = F.when(
        priority.isin("1-URGENT", "2-HIGH"), YOREH_DEAH.key
    ).otherwise(ORACH_CHAYIM.key)
    name = (
        F.when(priority == "1-URGENT", "Siftei Kohen on Shulchan Arukh, Yoreh De'ah")
        .when(priority == "2-HIGH", "Turei Zahav on Shulchan Arukh, Yoreh De'ah")
        .when(priority == "3-MEDIUM", "Magen Avraham")
        .when(priority == "4-NOT SPECIFIED", "Mishnah Berurah")
        .otherwise("Turei Zahav on Shulchan Arukh, Orach Chayim")
    )
    base = F.concat(F.lit(f"{BASE_WORK}, "), corpus, F.lit(" "), unit, F.lit(":"), section)
    other = F.concat(name, F.lit(" "), unit, F.lit(":"), section, F.lit(":1"))
    return orders.select(
        "o_orderkey",
        corpus.alias("corpus"),
        F.col("o_custkey").alias("unit"),
        F.when(status == "O", other).otherwise(base).alias("ref"),
        F.when(status == "O", base).when(status == "F", other).alias("anchor_ref"),
    )


def order_specs(orders: DataFrame) -> DataFrame:
    """Range specs of every kind, broken ones included, from the customer key."""
    k = F.col("o_custkey")

    def spec(pattern: str, *numbers: Column) -> Column:
        return F.format_string(pattern, *numbers)

    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    target = (
        F.when(priority == "1-URGENT", spec("%d", k))
        .when(priority == "2-HIGH", spec("%d-%d, %d-%d", k, k + 5, k + 3, k + 9))
        .when(priority == "3-MEDIUM", spec("%d,%d,%d", k + 7, k, k))
        .when(priority == "4-NOT SPECIFIED", spec("%d-%d", k + 5, k))
        .otherwise(spec(" %d , %d-%d", k, k + 1, k + 2))
    )
    context = F.when(status == "O", spec("%d-%d", k + 1, k + 4)).when(
        status == "P", spec("%d,%d-%d", k + 2, k + 20, k + 22)
    )
    limit = F.when(status == "O", 1).when(status == "P", 2)
    return orders.select(
        "o_orderkey",
        target.alias("target_spec"),
        context.alias("context_spec"),
        limit.alias("target_limit"),
    )


# Units of a long request, and one request in so many is one.
LONG = 10_000_000
LONG_EVERY = 5000


def order_requests(orders: DataFrame) -> DataFrame:
    """The specs of :func:`order_specs`; some ask for ten million units."""
    is_long = F.col("o_orderkey") % LONG_EVERY == 3
    spec = F.when(is_long, F.lit(f"5,7-{LONG + 6}")).otherwise(F.col("target_spec"))
    return order_specs(orders).withColumn("target_spec", spec)


def _is_long(customer: Column) -> Column:
    return customer % LONG_EVERY == 7


def customer_requests(customer: DataFrame) -> DataFrame:
    """A request per customer: one document as target, with the next ones as context; some ask
    for ten million as targets."""
    k = F.col("c_custkey")
    target = F.when(_is_long(k), F.format_string("%d-%d", k, k + LONG - 1)).otherwise(k.cast("string"))
    return customer.select(
        F.lit(YOREH_DEAH.key).alias("corpus"),
        F.col("c_custkey").alias("request_id"),
        target.alias("target_spec"),
        F.format_string("%d-%d", k + 1, k + 2).alias("context_spec"),
        F.lit(None).cast("int").alias("target_limit"),
    )


def customer_relations(customer: DataFrame) -> DataFrame:
    """Relations texts for the ranges of :func:`customer_requests`; some are empty."""
    k = F.col("c_custkey")
    last = F.when(_is_long(k), k + LONG - 1).otherwise(k + 2)
    return customer.where(F.col("c_mktsegment") != "BUILDING").select(
        F.format_string("%d-%d", k, last).alias("range_key"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("text"),
    )


def documents_as_drafts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.lit(YOREH_DEAH.key).alias("corpus"), F.col("doc_id").alias("unit"), "text"
    )
