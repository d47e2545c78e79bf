"""Cleaning pipeline over ``documents``: toxicity, near duplicates, repeated passages, packing.

Each stage takes what the one before kept, as a written table, and returns the
columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import near_duplicates, packing, repeats, toxicity
from corpusweave.llm.common import written
from corpusweave.llm.queries import table, vocabulary


WORD = r"[^\x20\x09-\x0D]"
# A repeated passage goes if it has over 50 words; so many in a row have 200 bytes and more.
PASSAGE_WORDS = 51
PASSAGE = 200


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with every column but id and text under a name that clashes with none, and the
    columns that give them their names back."""
    inner = [c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)]
    back = [F.col(a).alias(c) for a, c in zip(inner, docs.columns)]
    return docs.toDF(*inner), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; null and empty texts are judged as
    empty ones, repeated rows alike, and columns of any name and kind stay as they are."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    inner, back = _apart(docs)
    return toxicity.toxicity(inner, labels).where("is_toxic = 0").select(back)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), that of
    the smallest id; of rows that repeat an id and text, one.  Documents without a word, null
    texts among them, all stay; columns of any name and kind stay as they are."""
    inner, back = _apart(docs)
    linked = near_duplicates.near_duplicates(docs.select("doc_id", "text"), width=5).where("node is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    chosen = linked.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    row = near_duplicates.row_digest("doc_id", "text")
    rows = inner.where(words).withColumn("row", row).join(chosen, "row").dropDuplicates(["row"])
    return rows.select(back).union(inner.where(~words).select(back))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words (and 200 bytes or more) that stand elsewhere
    too; a character that a cut splits goes.  Null texts stay null, own columns as they are."""
    cut = repeats.without_repeats(docs, length=PASSAGE, min_words=PASSAGE_WORDS)
    text = F.when(F.col("record.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"record.`{c}`") for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, packed; a null or empty text is its end mark alone."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_copies),
    ("repeats", drop_repeats),
    ("packing", pack_documents),
]

# classifiers, minimum hashes and tokenizers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
