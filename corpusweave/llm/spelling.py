"""Spelling variants: words one edit apart, found through a reduced alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import hashing
from corpusweave.llm.common import written

RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
# one run in so many loses a code point, chosen by a hash of its document and itself
LOSES = 97
SYMBOLS = 16
SLICE = 4096
# bits of the filter that keeps keys no reduced word has out of the shuffle: 8 MB, whatever
# the vocabulary; a larger one lets more keys pass
FILTER_BITS = 1 << 26


def runs(text: Column) -> Column:
    """Maximal runs of letters (Latin-1), only A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(RUN), F.lit(0))


def noted(key: Column, run: Column) -> Column:
    """A run as it counts: where 97 divides h, the crc32 of ``<key>:<run>``, without its code
    point h % length."""
    mark = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (mark % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(mark % LOSES == 0, cut).otherwise(run)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: what counts of all runs, of five code points and three occurrences at least."""
    found = docs.select(F.col(key).alias("key"), F.explode(runs(F.col(text))).alias("run"))
    # a run that comes to fewer than five code points is none; one shorter than that never is
    found = found.where(F.length("run") >= MIN_LENGTH).select(noted(F.col("key"), F.col("run")).alias("word"))
    found = found.where(F.length("word") >= MIN_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def reduced(codes: np.ndarray) -> np.ndarray:
    """A symbol from 1 to 16 for each code point, by its hash."""
    return (hashing.mix(codes.astype(np.uint64)) % np.uint64(SYMBOLS)) + np.uint64(1)


def neighbourhood(symbols: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Keys of reduced words of one length (a row each): own keys; then (row, key) of all that
    one replacement or one deletion makes of a word, itself included.

    A key is the polynomial hash of a reduced word, so a change at one place is
    one addition.  An insertion is the deletion of the other word.  Deleting
    either of two equal neighbours gives the same, so only the first does.
    """
    n, length = symbols.shape
    up, down = hashing.Powers.of(length)
    weighted = symbols * up[:length]
    before = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(weighted, axis=1)), axis=1)
    whole = before[:, -1]
    others = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    replaced = whole[:, None, None] + (others - symbols[:, :, None]) * up[:length][:, None]
    new = others != symbols[:, :, None]
    deleted = before[:, :-1] + (whole[:, None] - before[:, 1:]) * down[1]
    first = np.concatenate((np.ones((n, 1), bool), symbols[:, 1:] != symbols[:, :-1]), axis=1)

    def tagged(keys: np.ndarray, length: int) -> np.ndarray:
        return hashing.mix(keys + np.uint64(length * hashing.BASE % (1 << 64)))

    row = np.arange(n)
    own = tagged(whole, length)
    parts = [
        (row, own),
        (np.nonzero(new)[0], tagged(replaced[new], length)),
        (np.nonzero(first)[0], tagged(deleted[first], length - 1)),
    ]
    return own, (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _bits_of(held: DataFrame) -> np.ndarray:
    """A bitmap of the keys of ``held(key)``: 2**20 words at most come to the driver."""
    bit = F.pmod("key", F.lit(FILTER_BITS))
    words = (
        held.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    found = np.zeros(FILTER_BITS >> 6, np.uint64)
    found[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return found


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Ordered pairs ``word, n, other, other_n`` of words that one inserted, deleted or replaced
    code point tells apart.

    Letters are hashed to 16 symbols.  Each word asks for all reduced words that
    one edit makes of its own (its own among them, as a replacement may keep the
    symbol), joined with the reduced words of the vocabulary; what meets is
    verified on the words themselves.  Keys that no reduced word has are
    dropped in the task that makes them.
    """

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        listed = batch.column(0).to_pylist()
        lengths = np.array([len(w) for w in listed])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            step = max(1, SLICE * 8 // int(length))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                joined = "".join([listed[i] for i in part])
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                yield part, reduced(codes.reshape(len(part), length))

    def rows(batch: pa.RecordBatch, at: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(key.view(np.int64)), *[c.take(pa.array(at)) for c in batch.columns]]
        return pa.RecordBatch.from_arrays(columns, ["key", "word", "n"])

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, symbols in by_length(batch):
                yield rows(batch, part, neighbourhood(symbols)[0])

    given = vocabulary.select("word", "n")
    schema = "key long, word string, n long"
    held = given.mapInArrow(own_keys, schema)
    bits = vocabulary.sparkSession.sparkContext.broadcast(_bits_of(held.select("key")))

    def asked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, symbols in by_length(batch):
                row, key = neighbourhood(symbols)[1]
                bit = key % np.uint64(FILTER_BITS)
                some = (bits.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                # a word asks for a key once
                pairs = np.unique(np.rec.fromarrays([row[some], key[some]], names="row,key"))
                yield rows(batch, part[pairs["row"]], np.ascontiguousarray(pairs["key"]))

    asked = given.mapInArrow(asked_keys, schema)
    met = asked.join(held.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key")
    near = met.where("word <> other").where(F.levenshtein("word", "other", 1) == 1)
    there = F.struct("word", "n", "other", "other_n")
    back = F.struct(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    # a longer word asks for the shorter ones, not they for it
    longer = F.length("word") > F.length("other")
    return near.select(F.inline(F.when(longer, F.array(there, back)).otherwise(F.array(there))))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that ``forms(word, form)`` lead to.

    Each form has at least twice its word's occurrences, so no path is a cycle.
    Paths are halved until they end; each round is a written table.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(at.join(onward, "root", "left").select("word", "root", "next"))
        at = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.where("next is not null").isEmpty():
            return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all texts, each with the more frequent word that it is a variant of.

    Words are runs of Latin letters as :func:`words` counts them.  Two words are
    near if one inserted, deleted or replaced code point tells them apart; the
    form of a word is its near word of most occurrences (of equals the smallest
    in code-point order) if it has at least twice the word's own.

    Returns a row per word: ``word, form, root`` (the last of the forms; the word
    itself without one), ``n, n_near, form_n``.  Null and empty texts have no
    words; a null id counts as an empty one; of rows that repeat an id each
    counts.  No words give an empty table.  Other columns are not looked at,
    whatever their names.
    """
    vocabulary = written(words(docs, key, text))
    near = near_words(vocabulary)
    # of most occurrences, then the smallest
    first = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("first")
    chosen = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first)
    strong = -F.col("first.less") >= 2 * F.col("n")
    named = written(
        vocabulary.join(chosen, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("first.other")).alias("form"),
            F.when(strong, -F.col("first.less")).alias("form_n"),
        )
    )
    led = roots(named.where("form is not null"))
    return named.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
