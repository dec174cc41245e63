"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed words, pairs of neighbours and pairs with one word
between them. The learner keeps a rate per coordinate, and its L1 term leaves most weights at
zero, so that the model is a short list of numbers that every task can have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import ship_package
from .buffers import IS_LETTER, mixed, slices, texts_of

# Hashed feature space; a model has at most so many weights, which bounds what is broadcast.
BUCKETS = 1 << 20
# Labelled rows used for training at most: those with the smallest hashes of their ids.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Text number and bucket of every n-gram and skip-gram occurrence, and the number of texts."""
    texts = texts_of(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, owner = texts.words(IS_LETTER)
    words = texts.spans_hash(starts, ends)
    owners, buckets = [owner], [words]
    for gap in (1, 2):
        together = owner[gap:] == owner[:-gap]
        pairs = mixed(words[:-gap] + np.uint64(gap)) + words[gap:]
        owners.append(owner[gap:][together])
        buckets.append(mixed(pairs[together]))
    places = (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return np.concatenate(owners), places, len(texts.offsets) - 1


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    rate: float = 1.0,
    smooth: float = 1.0,
    l1: float = 3.0,
    l2: float = 0.1,
    epochs: int = 4,
) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over rows of distinct buckets: buckets with weight, weights, and the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        # The last coordinate is the bias, which L1 leaves alone.
        slack = np.where(at == BUCKETS, 0.0, l1)
        shrunk = np.sign(own) * np.maximum(np.abs(own) - slack, 0.0)
        return -shrunk / ((smooth + np.sqrt(n[at])) / rate + l2)

    order = np.random.default_rng(7).permutation
    for _ in range(epochs):
        for i in order(len(rows)):
            at = np.append(rows[i], BUCKETS)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / rate
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    w = weights(np.arange(BUCKETS + 1))
    used = np.flatnonzero(w[:-1])
    return used.astype(np.int32), w[used], float(w[-1])


def calibrated(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A fit whose bias is moved so that THRESHOLD divides the classes best.

    L1 draws the scores of the rarer class towards the middle. Every fifth row is left out of a
    first fit and gives the cut with the best F1; then all rows are learned.
    """
    aside = np.arange(len(rows)) % 5 == 4
    used, weights, bias = fit([r for r, a in zip(rows, aside) if not a], labels[~aside])
    table = np.zeros(BUCKETS)
    table[used] = weights
    logits = np.array([table[r].sum() + bias for r, a in zip(rows, aside) if a])
    marks = labels[aside]
    used, weights, bias = fit(rows, labels)
    if marks.any() and not marks.all():
        order = np.argsort(-logits, kind="stable")
        found = np.cumsum(marks[order])
        f1 = 2 * found / (np.arange(1, len(order) + 1) + marks.sum())
        best = int(np.flatnonzero(f1 == f1.max())[-1])
        below = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
        # Two thirds of the way down the gap: unseen toxic rows score lower than learned ones.
        cut = logits[order[best]] - (logits[order[best]] - below) * 2 / 3
        bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return used, weights, bias


def held_out(id_column: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAINING_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> dict:
    """A model from labelled rows that are not held out; ``max_rows`` bounds them.

    Labels other than 0 and 1 and null labels or ids are left out; of several labels of an id the
    largest counts. Without any labelled row the model scores every text 0.5. The rows' features
    are made by the executors; one task learns from the bounded sample, and the driver gets
    the weights that are not zero.
    """
    ship_package(docs.sparkSession)
    known = labels.select(
        F.col(f"`{id_column}`").alias("__id"), F.col(f"`{label_column}`").cast("int").alias("__label")
    ).filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "__id")  # at most max_rows pairs of numbers

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, bucket, count = features(batch.column(1))
            both = np.unique(owner.astype(np.int64) * BUCKETS + bucket)
            sizes = np.bincount(both // BUCKETS, minlength=count)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array((both % BUCKETS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["id", "label", "buckets"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, marks = [], []
        for batch in batches:
            lists = batch.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().copy()
            examples += [values[a:b] for a, b in zip(offsets, offsets[1:])]
            marks.append(batch.column(1).to_numpy())
        if examples:
            used, weights, bias = calibrated(examples, np.concatenate(marks))
            out = [pa.array(np.append(used, BUCKETS).astype(np.int32)), pa.array(np.append(weights, bias))]
            yield pa.RecordBatch.from_arrays(out, ["bucket", "weight"])

    kind = rows.schema["__id"].dataType.simpleString()
    rows = rows.select("__id", "text", "__label").mapInArrow(featured, f"id {kind}, label int, buckets array<int>")
    # One task for the bounded sample; the sort makes reruns agree.
    sample = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", F.xxhash64("buckets"))
    found = sample.mapInArrow(learned, "bucket int, weight double").toPandas()
    bias = found.loc[found.bucket == BUCKETS, "weight"].sum()
    found = found[found.bucket < BUCKETS]
    return {"buckets": found.bucket.to_numpy(), "weights": found.weight.to_numpy(), "bias": float(bias)}


def score(docs: DataFrame, model: dict, text_column: str = "text", kept: tuple[str, ...] | None = None) -> DataFrame:
    """The ``kept`` columns of ``docs`` (all by default) with ``score``, from 0 to 1; higher is likelier toxic.

    Every row is scored by its whole text alone. Null and empty texts get the score of a text
    without any known feature.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        known = shared.value
        weight = np.zeros(BUCKETS)
        weight[known["buckets"]] = known["weights"]
        logits = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
            owner, bucket, count = features(part.column(0))
            telling = weight[bucket] != 0
            both = np.unique(owner[telling].astype(np.int64) * BUCKETS + bucket[telling])
            logits.append(np.bincount(both // BUCKETS, weights=weight[both % BUCKETS], minlength=count) + known["bias"])
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(logits), -30, 30))))

    columns = [F.col(f"`{c}`") for c in (kept if kept is not None else docs.columns)]
    return docs.select(*columns, probability(F.col(f"`{text_column}`").cast("string")).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns unchanged."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text"))
    scored = score(packed, train(docs, labels))
    return scored.filter(F.col("score") < threshold).select("__row.*")
