"""Toxicity scores from non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import written
from corpusweave.llm.hashing import BASE

GRAMS = (4, 5, 6)
HASH_BITS = 30
SIEVE_BITS = 20
# runs that a task holds before it counts them
COUNT_RUNS = 4_000_000
THRESHOLD = 0.7
# the classifier is fitted on at most so many confirmed toxic and unlabelled texts
MAX_POSITIVE = 1500
MAX_UNLABELLED = 3000
MAX_FEATURES = 1536
MIN_LIFT = 2.0
STEPS = 400
RATE = 0.05
DECAY = 1e-4
BLOCK_BYTES = 1 << 20


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """30-bit hashes of the runs of 4, 5 and 6 bytes of the lower-cased text, block by block."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES + max(GRAMS) - 1].astype(np.uint64)
        run = np.zeros(len(part), np.uint64)
        for width in range(1, max(GRAMS) + 1):
            n = len(part) - width + 1
            if n <= 0:
                break
            run = (run[:n] << np.uint64(8)) | part[width - 1 :]
            if width in GRAMS:
                mixed = (run[:BLOCK_BYTES] + np.uint64(width << 56)) * np.uint64(BASE)
                yield (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def distinct_grams(text: str | None) -> np.ndarray:
    found = list(gram_hashes(text))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Classifier:
    """Weights of runs of bytes that occur in a text, and a bias."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.grams & ((1 << SIEVE_BITS) - 1)] = True

    def score(self, text: str | None) -> float:
        """Probability of toxic; every part of the text counts, each run once."""
        found = []
        for hashes in gram_hashes(text):
            maybe = hashes[self.sieve[hashes & ((1 << SIEVE_BITS) - 1)]]
            if len(maybe) and len(self.grams):
                at = np.minimum(np.searchsorted(self.grams, maybe), len(self.grams) - 1)
                found.append(np.unique(at[self.grams[at] == maybe]))
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum(), -500, 500))))


def count_grams(texts: DataFrame) -> DataFrame:
    """``gram, p, u``: in how many of the positive and unlabelled ``texts(p, text)`` a run occurs.

    Tasks count what they have read whenever it comes to a few million runs, so
    what is shuffled are different runs, not occurrences.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        flags: list[int] = []

        def counted() -> pa.RecordBatch:
            grams, at = np.unique(np.concatenate(held), return_inverse=True)
            positive = np.repeat(np.array(flags, np.int64), [len(h) for h in held])
            p = np.bincount(at, weights=positive, minlength=len(grams)).astype(np.int64)
            u = np.bincount(at, minlength=len(grams)) - p
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(p), pa.array(u)], ["gram", "p", "u"])

        for batch in batches:
            for flag, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(distinct_grams(text.as_py()))
                flags.append(flag)
                if sum(map(len, held)) > COUNT_RUNS:
                    yield counted()
                    held.clear()
                    flags.clear()
        if held:
            yield counted()

    counts = texts.select("p", "text").mapInArrow(tally, "gram int, p long, u long")
    return counts.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def choose_grams(counts: DataFrame, positive: int, unlabelled: int) -> np.ndarray:
    """The runs whose share of texts differs most surely between the two samples: at most
    ``MAX_FEATURES`` of ``counts(gram, p, u)`` reach the driver."""
    shares = counts.select("gram", (F.col("p") / positive).alias("p"), (F.col("u") / unlabelled).alias("u"))
    spread = F.sqrt((F.col("p") + F.col("u")) / 2 * (1 / positive + 1 / unlabelled) + 1e-9)
    least = F.greatest(F.least("p", "u"), F.lit(1 / (positive + unlabelled)))
    sure = shares.where(F.greatest("p", "u") / least >= MIN_LIFT).select(
        "gram", (F.abs(F.col("p") - F.col("u")) / spread).alias("sure")
    )
    best = sure.where("sure > 3").orderBy(F.desc("sure"), "gram").limit(MAX_FEATURES)
    return np.sort(best.select("gram").toArrow().column("gram").to_numpy()).astype(np.int32)


def feature_rows(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``p, found``: the places in ``chosen`` of the runs that occur in each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.flatnonzero(np.isin(chosen, distinct_grams(t.as_py()), assume_unique=True)).astype(np.int32)
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["p", "found"]
            )

    return texts.select("p", "text").mapInArrow(find, "p int, found array<int>")


def fit_nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Logistic weights of least non-negative risk.

    With prior pi, the risk of calling the negatives wrong is estimated as
    R_u(-) - pi R_p(-): unlabelled texts count as negative, less the positives
    among them.  Where the estimate falls below zero it has begun to fit noise,
    and the step goes the other way for that part.
    """
    width = x_p.shape[1]
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(x: np.ndarray, pull: np.ndarray) -> np.ndarray:
        return np.append(pull @ x, pull.sum()) / len(x)

    for step in range(1, STEPS + 1):
        z_p, z_u = x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1]
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_negative = gradient(x_u, s_u) - prior * gradient(x_p, s_p)
        if negative >= 0:
            g = prior * gradient(x_p, s_p - 1) + g_negative
        else:
            g = -g_negative
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Classifier:
    """Fit on texts confirmed toxic in ``labels(doc_id, toxic)`` and on texts taken as unlabelled.

    Texts are chosen by a hash of their id, at most ``max_positive`` and
    ``max_unlabelled`` of them.  Their runs of bytes are counted in Spark; the
    chosen runs and which text has which reach the driver.  The class prior is the toxic share of all labelled
    rows.  Without a toxic or an unlabelled text, every score is the prior
    (0 without labels).
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("prior")).first()
    prior = min(max(shares.prior or 0.0, 1e-6), 0.99)
    order = F.xxhash64("doc_id")
    toxic = known.where("toxic = 1").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    toxic = toxic.select("doc_id", F.lit(1).alias("p")).orderBy(order, "doc_id").limit(max_positive)
    other = docs.where("doc_id is not null").select("doc_id").distinct()
    other = other.select("doc_id", F.lit(0).alias("p")).orderBy(F.xxhash64(order), "doc_id").limit(max_unlabelled)
    # at most max_positive + max_unlabelled ids
    chosen = F.broadcast(toxic.union(other))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "p").agg(F.max("text").alias("text"))

    texts = written(texts)
    n = {r.p: r.n for r in texts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Classifier(np.zeros(0, np.int32), np.zeros(0), float(np.log(prior / (1 - prior))))
    chosen_grams = choose_grams(count_grams(texts), n[1], n[0])
    sample = feature_rows(texts, chosen_grams).toArrow()

    def matrix(kind: int) -> np.ndarray:
        rows = sample.filter(pa.compute.equal(sample.column("p"), kind)).column("found")
        x = np.zeros((len(rows), len(chosen_grams)))
        for row, found in zip(x, rows):
            row[found.values.to_numpy()] = 1
        return x

    weights, bias = fit_nnpu(matrix(1), matrix(0), prior)
    return Classifier(chosen_grams, weights, bias)


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``is_toxic`` (1 from ``threshold`` on) in their place.

    Scores look at the text alone, in the row; null and empty texts get the
    score of no runs.  The model travels with the task (a few thousand numbers).
    """
    grams, weights, bias = classifier.grams, classifier.weights, classifier.bias

    @F.pandas_udf("double")
    def toxicity(texts):
        model = Classifier(grams, weights, bias)
        return texts.map(model.score)

    scored = docs.withColumn("toxicity", toxicity("text"))
    return scored.withColumn("is_toxic", (F.col("toxicity") >= threshold).cast("int"))


def learnable(df: DataFrame) -> DataFrame:
    """Rows that may be learned from: CRC-32 of the id as text is not 1 modulo 3."""
    return df.where("crc32(cast(doc_id as string)) % 3 <> 1")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the learnable rows and score all documents."""
    return score(docs, train(learnable(docs), learnable(labels)), threshold)
