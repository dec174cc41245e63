"""Document fingerprints by consistent weighted sampling.

The terms of a text are its pairs of neighbouring words, weighted by how often they occur. For
each of SAMPLES independent samples every term draws two gamma variables and a uniform one, which
depend on the term and the sample alone; the term whose weight makes its draw smallest is the
sample, together with a quantised weight. Two texts agree on a sample with a probability equal to
the generalised Jaccard similarity of their weights (sum of minima over sum of maxima).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import ship_package, stored
from .buffers import mixed, slices, texts_of
from .shared import small

SAMPLES = 64
# Terms whose values are tabled at once (16 MB for 64 samples), and drawn at once; they bound memory
# for very long texts, whose terms are looked at block by block.
TABLED, DRAWN = 1 << 16, 1 << 10
# Documents that follow one another by id are dealt to shards of about this many rows, but to no
# more shards than MAX_SHARDS; a larger shard is only a longer stream for its task.
SHARD_ROWS, MAX_SHARDS = 5_000, 8_192
_DIGITS = 8


def _draws(terms: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) rates, log gamma(2, 1) scales and uniform offsets, by 64-bit term and sample.

    A gamma(2, 1) variable is minus the logarithm of a product of two uniform ones, of 24 bits each.
    """
    first = mixed(terms ^ salts)
    second = mixed(first + np.uint64(0xA24BAED4963EE407))

    def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)

    def gamma(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        u = ((a >> np.uint32(8)).view(np.int32) + np.int32(1)).astype(np.float32)
        v = ((b >> np.uint32(8)).view(np.int32) + np.int32(1)).astype(np.float32)
        return np.maximum(-np.log(u * np.float32(2**-24) * (v * np.float32(2**-24))), np.float32(1e-9))

    a, b = halves(first)
    bits = (a & np.uint32(255)) << np.uint32(8) | (b & np.uint32(255))
    offset = bits.view(np.int32).astype(np.float32) * np.float32(2**-16)
    return gamma(a, b), np.log(gamma(*halves(second))), offset


def _levels(weight: np.ndarray, rate: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Quantised logarithms of weights; those of weight 1 are 0."""
    return np.floor(np.log(weight).astype(np.float32) / rate + offset)


def _values(terms: np.ndarray, weight: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """What the samples minimise, by term and sample."""
    out = np.empty((len(terms), len(salts)), np.float32)
    for at in range(0, len(terms), DRAWN):
        part, some = out[at : at + DRAWN], weight[at : at + DRAWN]
        rate, scale, offset = _draws(terms[at : at + DRAWN, None], salts)
        part[:] = scale - rate * (1 - offset)
        heavy = np.flatnonzero(some > 1)
        part[heavy] -= rate[heavy] * _levels(some[heavy, None], rate[heavy], offset[heavy])
    return out


def signatures(column: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """One row of 32-bit samples per text; texts without words get zeros, and only they do."""
    texts = texts_of(column)
    starts, ends, owner = texts.words()
    words = texts.spans_hash(starts, ends)
    together = owner[1:] == owner[:-1]
    count = len(texts.offsets) - 1
    out = np.zeros((count, samples), np.uint32)
    if not len(words):
        return out
    alone = np.flatnonzero(np.bincount(owner, minlength=count) == 1)
    pairs = mixed(mixed(words[:-1]) + words[1:])[together]
    terms = np.concatenate([pairs, words[np.searchsorted(owner, alone)]])
    owners = np.concatenate([owner[1:][together], alone]).astype(np.int64)
    terms, number = np.unique(terms, return_inverse=True)
    both, weight = np.unique(owners * len(terms) + number, return_counts=True)
    owners, number = np.divmod(both, len(terms))
    # Texts that have a term equally often share its values; these rows ascend by term.
    most = int(weight.max()) + 1
    rows, row = np.unique(number * most + weight, return_inverse=True)
    row_term, row_weight = terms[rows // most], rows % most
    salts = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    best = np.full((count, samples), np.inf, np.float32)
    chosen = np.zeros((count, samples), np.int64)
    place = row // TABLED * count + owners
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    tabled = -1
    for a, b in zip(cuts[:-1], cuts[1:]):
        at, i = divmod(int(place[a]), count)
        if at != tabled:
            tabled, low = at, at * TABLED
            table = _values(row_term[low : low + TABLED], row_weight[low : low + TABLED], salts)
        value = table[row[a:b] - low]
        least = value.argmin(axis=0)
        value = value[least, np.arange(samples)]
        better = value < best[i]
        best[i, better] = value[better]
        chosen[i, better] = row[a + least[better]]
    some = np.unique(owners)
    term, heavy = row_term[chosen[some]], row_weight[chosen[some]]
    rate, _, offset = _draws(term, salts)
    level = _levels(heavy, rate, offset).astype(np.int64).astype(np.uint64)
    name = mixed(mixed(term) + level)
    out[some] = (name | np.uint64(1)).astype(np.uint32)
    return out


def _hex(signature: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signature]


def likeness(a: str, b: str) -> float:
    """Share of samples on which two fingerprints agree."""
    pieces = range(0, len(a), _DIGITS)
    return sum(a[i : i + _DIGITS] == b[i : i + _DIGITS] for i in pieces) / max(len(pieces), 1)


def fingerprint(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """The id and ``fingerprint`` (hex, 8 digits per sample) of every row; equal texts have equal fingerprints.

    Null and empty texts, and texts of white space only, have a fingerprint of zeros. Other
    columns are not read; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = _hex(signatures(batch.column(1), samples))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], [id_column, "fingerprint"])

    return rows.mapInArrow(run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def with_successor(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (shard, id, text, lent) such that within a shard, by descending id, every row has its successor.

    Ranges of ids are shards. The first row of the next shard comes along as ``lent`` at the
    end, and the last shard borrows the first row of all; only ids are looked at to find them.
    Ids are
    numbers; equal ones are ordered by a hash of their texts, null ids come last.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))).alias("tie"),
    )
    pieces = min(max(1, -(-docs.count() // SHARD_ROWS)), MAX_SHARDS)
    at = [k / pieces for k in range(1, pieces)]
    number = F.col("id").cast("double")
    cuts = rows.select(F.percentile_approx(number, at, 4 * MAX_SHARDS)).first()[0] if at else None
    splits = [-math.inf, *sorted(set(cuts or [])), math.inf]
    # Shards count down from the largest ids; null ids make the last one.
    placed = rows.withColumn("number", number)
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="number", outputCol="range", handleInvalid="keep").transform(placed)
        shard = F.when(F.col("id").isNull(), F.lit(len(splits))).otherwise(len(splits) - 2 - F.col("range"))
    else:
        shard = F.col("id").isNull()
    placed = placed.select("id", "text", "tie", shard.cast("int").alias("shard"))
    # One row per shard: its first row, lent to the shard before it (the first of all to the last).
    heads = placed.groupBy("shard").agg(F.max(F.struct(F.col("id"), F.bitwise_not("tie").alias("tie"))).alias("head"))
    around = Window.orderBy("shard")
    last = F.max("shard").over(Window.partitionBy(F.lit(0)))
    heads = heads.select("head", F.coalesce(F.lag("shard").over(around), last).alias("borrower"))
    heads = stored(heads.select(F.col("head.id").alias("h_id"), F.bitwise_not("head.tie").alias("h_tie"), "borrower"), "heads")
    lent = rows.join(small(heads), rows["id"].eqNullSafe(F.col("h_id")) & (rows["tie"] == F.col("h_tie")))
    lent = lent.select("id", "text", "tie", F.col("borrower").alias("shard")).dropDuplicates(["id", "tie", "shard"])
    every = placed.withColumn("lent", F.lit(False)).unionByName(lent.withColumn("lent", F.lit(True)))
    order = ["shard", "lent", F.col("id").desc_nulls_last(), "tie"]
    return every.repartition("shard").sortWithinPartitions(*order).select("shard", "id", "text", "lent")


def compare_edits(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are.

    The edit replaces the last half of a text's characters by as many from the beginning of the
    next document in descending order of ids (the first follows the last). One row per row:
    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A single
    row is its own successor. Null counts as empty. Texts are shuffled once.
    """
    ship_package(docs.sparkSession)
    ordered = with_successor(docs, id_column, text_column)
    kind = ordered.schema["id"].dataType.simpleString()

    def compared(batch: pa.RecordBatch, after: str | None) -> pa.RecordBatch:
        """Rows of one shard with the text after the last; a lent row is only ever looked at."""
        texts = batch.column(2).to_pylist()
        following = [*texts[1:], after or ""]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
        # Together, as an edit shares nearly all of its terms with these texts.
        every = signatures(pa.array([*texts, following[-1], *edited], pa.large_string()), samples)
        own, changed = every[: len(texts) + 1], every[len(texts) + 1 :]
        near_edited = (own[:-1] == changed).mean(axis=1)
        near_next = (own[:-1] == own[1:]).mean(axis=1)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(1),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(_hex(own[:-1])),
                pa.array(_hex(changed)),
                pa.array(near_edited),
                pa.array(near_next),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, "text"):
            if held is not None:
                yield from finished(held, batch.column(2)[0].as_py())
            held = batch
        if held is not None:
            yield from finished(held, None)

    def finished(batch: pa.RecordBatch, after: str | None) -> Iterator[pa.RecordBatch]:
        """A shard ends with its lent row, which itself gives no result."""
        lent = batch.column(3).to_numpy(zero_copy_only=False)
        begin = 0
        for end in [*np.flatnonzero(lent).tolist(), batch.num_rows]:
            if end > begin:
                follows = batch.column(2)[end].as_py() if end < batch.num_rows else after
                yield compared(batch.slice(begin, end - begin), follows)
            begin = end + 1

    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        f"`{id_column}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return ordered.mapInArrow(run, schema)
