"""Which texts contain which: an index of rare byte n-grams in place of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.session import scratch_table

# (bytes of a gram, grams of a window) by the length of a needle: the first that fits counts.
# A window of a needle is a window of every text that holds it, so both have its least gram.
CLASSES = ((16, 17), (8, 9), (4, 5), (2, 1), (1, 1))
# Bits of the filters that keep what can't match out of the shuffles, whatever their content:
# a megabyte in a task.
FILTER_BITS = 1 << 23

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Distinct least gram hashes of all windows of a text; none if it is shorter than one."""
    n = len(data) - gram + 1
    if n < window:
        return np.zeros(0, np.uint64)
    wide, held = data.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(gram):
        held = held * _BASE + wide[k : k + n] + np.uint64(1)
    held = _mixed(held)
    least = held[: n - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, held[k : k + len(least)], out=least)
    return np.unique(least)


def _bit(grams: np.ndarray, class_: int) -> np.ndarray:
    return _mixed(grams + np.uint64(class_)) % np.uint64(FILTER_BITS)


def _has(bits: np.ndarray, grams: np.ndarray, class_: int) -> np.ndarray:
    at = _bit(grams, class_)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bitmap(asked: DataFrame) -> np.ndarray:
    """The bits of all ``asked(class, gram)``: a task sends its bitmap's set bytes, a million at
    most, and as many come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            grams = batch.column(1).to_numpy().view(np.uint64)
            for c in np.unique(batch.column(0).to_numpy()):
                at = _bit(grams[batch.column(0).to_numpy() == c], int(c))
                np.bitwise_or.at(held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].astype(np.int64))], ["at", "bits"])

    parts = asked.select("class", "gram").mapInArrow(run, "at long, bits long")
    found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return bits


def _gram_rows(
    texts: DataFrame, classes: list[int], own_class: bool, bits: np.ndarray | None = None
) -> DataFrame:
    """``(id, class, gram)`` of texts ``(id, text)``: for the class of each text's length, or
    for every one of ``classes``; with ``bits`` only grams whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows, of = [], [], []
            for i, text in enumerate(batch.column(1)):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                fits = [c for c in classes if len(data) >= sum(CLASSES[c]) - 1]
                for c in fits[:1] if own_class else fits:
                    grams = anchors(data, *CLASSES[c])
                    if bits is not None:
                        grams = grams[_has(bits, grams, c)]
                    found.append(grams)
                    rows.append(np.full(len(grams), i))
                    of.append(np.full(len(grams), c, np.int32))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate(rows))),
                        pa.array(np.concatenate(of)),
                        pa.array(np.concatenate(found).view(np.int64)),
                    ],
                    ["id", "class", "gram"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, class int, gram long")


def may_match(df: DataFrame, key: list[Column], wanted: DataFrame, wanted_key: list[Column]) -> DataFrame:
    """Rows of ``df`` whose key may be one of ``wanted``: a bitmap of 2**23 bits, one hash a key.

    The bitmap is at most 131 072 rows of a word each, so broadcasting it is
    safe whatever ``wanted`` holds; with very many keys it lets all rows pass.
    """
    bit = lambda k: F.pmod(F.xxhash64(*k), F.lit(FILTER_BITS))
    words = (
        wanted.select(bit(wanted_key).alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits"))
    )
    marked = df.withColumn("_bit", bit(key)).withColumn("_word", F.shiftright("_bit", 6))
    return (
        marked.join(F.broadcast(words), "_word")
        .where(F.expr("shiftright(_bits, cast(_bit & 63 as int)) & 1L = 1L"))
        .select(df.columns)
    )


def contained_texts(
    texts: DataFrame, needles: DataFrame, key: str, needle_key: str, text: str = "text"
) -> DataFrame:
    """``(key, needle_key)`` of every text that contains a needle, byte for byte.

    Texts and needles are reduced to the least hashed grams of their sliding
    windows.  A needle is looked up by the one of its grams that fewest texts
    have, so a gram that is in many texts is used only where a needle has
    no other; such a join is one that AQE splits.  What meets is verified
    by ``contains`` on the whole texts.  Only texts that may hold a needle are
    shuffled: bitmaps of fixed size keep grams and texts out that can't.

    Keys are unique and not null.  An empty or null needle is contained in no text.
    """
    hay = texts.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sought = needles.select(F.col(needle_key).alias("id"), F.col(text).alias("text"))
    classes = list(range(len(CLASSES)))
    asked = scratch_table(_gram_rows(sought, classes, own_class=True), "grams")
    used = sorted(r["class"] for r in asked.select("class").distinct().collect())
    # texts are read once for their grams; those that some needle may have are few
    held = _gram_rows(hay, used, own_class=False, bits=_bitmap(asked))
    grams = scratch_table(held, "grams")
    spread = grams.groupBy("class", "gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = (
        asked.join(spread, ["class", "gram"])
        .groupBy("id")
        .agg(F.min(F.struct("texts", "class", "gram")).alias("rarest"))
        .select(F.col("id").alias("needle"), "rarest.class", "rarest.gram")
    )
    pairs = grams.join(rarest, ["class", "gram"]).select("id", "needle")
    quoted = pairs.join(sought.select(F.col("id").alias("needle"), F.col("text").alias("sought")), "needle")
    found = may_match(hay, [F.col("id")], pairs, [F.col("id")]).join(quoted, "id")
    return found.where(F.contains("text", "sought")).select(
        F.col("id").alias(key), F.col("needle").alias(needle_key)
    )
