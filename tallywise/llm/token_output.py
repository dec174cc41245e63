"""Token ids as files of word-aligned Simple-8b blocks.

A file row is a segment of whole documents. Its ids are packed into 64-bit words: four bits of
selector, sixty bits of payload. The selector says how many ids of which width a word holds.
A run of one id takes one word, and an id of more than 60 bits an escape word and a raw one.
Every BLOCK ids a new block begins, on a word of its own; the segment lists where, so that any
block can be decoded alone, and all of them with whole-array operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import ship_package
from .buffers import slices, texts_of
from .vocab import LARGE_POOL, encoder, places

# Ids per word and bits per id, by selector; selectors 0 and 1 are the escape and the run.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, RUN = 0, 1
_PAYLOAD = np.uint64((1 << 60) - 1)
# A run word holds a count of 28 bits and an id of 32; it pays from LEAST_RUN equal ids on.
LEAST_RUN = 61
# Ids per block, and ids after which a segment ends (with the document that passes them).
BLOCK, SEGMENT_IDS = 4096, 1 << 18
END_ID = 1
SEGMENT_SCHEMA = (
    "shard int, segment int, ids_before long, n_ids long, doc_ids array<{id}>, lengths array<long>, "
    "blocks array<long>, words binary"
)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, as bytes."""
    exponent = np.frexp(ids.astype(np.float64))[1]
    # Above 2**53 rounding can only name a bit too many, never too few.
    return exponent.astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For every place of every row (a block): the selector that packs most ids from there on."""
    n = bits.shape[1]
    widest, selector = {1: bits}, np.zeros(bits.shape, np.uint8)
    for s in range(15, 1, -1):
        count = int(COUNTS[s])
        if count > 1 and count <= n:
            # Two overlapping windows of a length already done cover the wanted one, at times with a third.
            half = max(c for c in widest if c < count)
            size = n - count + 1
            most = np.maximum(widest[half][:, :size], widest[half][:, count - half : count - half + size])
            for start in range(half, count - half, half):
                most = np.maximum(most, widest[half][:, start : start + size])
            widest[count] = most
        if count <= n:
            selector[:, : n - count + 1][widest[count] <= WIDTHS[s]] = s
    return selector


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of non-negative ids, and the word at which each block of ``block`` ids begins."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.full(-(-n // block) * block, 255, np.uint8)  # nothing packs the padding
    bits[:n] = _widths(ids)
    selector = _selectors(bits.reshape(-1, block)).reshape(-1)[:n]
    taken = COUNTS.astype(np.uint8)[selector]
    equal = np.concatenate([ids[1:] == ids[:-1], [False]])
    bounds = np.flatnonzero(~equal)
    lengths = np.diff(bounds, prepend=-1)
    if lengths.max() >= LEAST_RUN:
        last = np.repeat(bounds, lengths)
        block_end = (np.arange(n) // block + 1) * block
        run = np.minimum(np.minimum(last + 1, block_end) - np.arange(n), 255)
        runs = (run >= LEAST_RUN) & (ids < np.uint64(1 << 32))
        selector[runs], taken[runs] = RUN, run[runs]
    step, at, i = taken.tobytes(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    chosen = selector[at]
    word_at = np.arange(len(at)) + np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(int(word_at[-1]) + 1 + int(chosen[-1] == ESCAPE), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            payload = (ids[at[mine][:, None] + np.arange(COUNTS[s])] << shift).sum(axis=1, dtype=np.uint64)
            words[word_at[mine]] = payload | np.uint64(s << 60)
    mine = np.flatnonzero(chosen == RUN)
    words[word_at[mine]] = (taken[at[mine]].astype(np.uint64) << np.uint64(32)) | ids[at[mine]] | np.uint64(RUN << 60)
    words[word_at[chosen == ESCAPE] + 1] = ids[at[chosen == ESCAPE]]
    return words, word_at[np.searchsorted(at, np.arange(0, n, block))]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # The word after an escape is raw, whatever its top bits say.
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    words_at = np.flatnonzero(~raw)
    selector = selector[words_at]
    payload = words[words_at] & _PAYLOAD
    counts = COUNTS[selector]
    counts[selector == RUN] = (payload[selector == RUN] >> np.uint64(32)).astype(np.int64)
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[at[mine][:, None] + np.arange(COUNTS[s])] = (payload[mine][:, None] >> shift) & mask
    mine = np.flatnonzero(selector == RUN)
    out[places(at[mine], counts[mine])] = np.repeat(payload[mine] & np.uint64((1 << 32) - 1), counts[mine])
    mine = np.flatnonzero(selector == ESCAPE)
    out[at[mine]] = words[words_at[mine] + 1]
    return out


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode all texts, append ``end_id`` to each, and write the ids to ``path`` in ascending order of the id column.

    Shards are ranges of ids, one per task; equal ids are ordered by a hash of their texts, null
    ids come first, null and empty texts hold the end id only. The files are Parquet whose rows are segments,
    so Spark commits them whole or not at all, and every row decodes alone. An empty table writes
    no segment. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    order = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, words = TaskContext.get().partitionId(), encoder(vocabulary, LARGE_POOL)
        number, before, ids, keys, lengths = 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            packed, blocks = pack(np.concatenate(ids))
            n = int(np.concatenate(lengths).sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([n], pa.int64()),
                    _one_list(pa.concat_arrays(keys)),
                    _one_list(pa.array(np.concatenate(lengths))),
                    _one_list(pa.array(blocks)),
                    pa.array([packed.astype("<u8").tobytes()], pa.binary()),
                ],
                ["shard", "segment", "ids_before", "n_ids", "doc_ids", "lengths", "blocks", "words"],
            )

        held = 0
        for batch in slices(batches, "text", keep=True):
            own, counts = words.encode(texts_of(batch.column(1)))
            full = np.full(len(own) + len(counts), end_id, np.uint32)
            full[places(np.cumsum(counts + 1) - counts - 1, counts)] = own
            ids.append(full)
            keys.append(batch.column(0))
            lengths.append(counts + 1)
            held += len(full)
            if held >= SEGMENT_IDS:
                yield segment()
                number, before, held, ids, keys, lengths = number + 1, before + held, 0, [], [], []
        if held:
            yield segment()

    ranged.mapInArrow(run, SEGMENT_SCHEMA.format(id=kind)).write.parquet(path)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def read_ids(spark: SparkSession, path: str, id_column: str = "doc_id", digest: bool = False) -> DataFrame:
    """Documents of files written by ``write_ids``: id, start (ids of all documents before it), n_tokens and ids.

    With ``digest`` the crc32 of the ids as little-endian 32-bit integers stands for the ids.
    What is gathered of all files is one number per shard.
    """
    ship_package(spark)
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(bases), "shard")  # one row per file
    placed = placed.select((F.col("base") + F.col("ids_before")).alias("start"), "doc_ids", "lengths", "words")
    last = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = unpack(np.frombuffer(row.column(3)[0].as_buffer(), "<u8"))
                lengths = row.column(2)[0].values.to_numpy()
                ends = np.cumsum(lengths)
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    content = pa.array(crcs, pa.int64())
                else:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    content = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))
                starts = pa.array(row.column(0)[0].as_py() + ends - lengths)
                names = [id_column, "start", "n_tokens", last.split()[0]]
                yield pa.RecordBatch.from_arrays([row.column(1)[0].values, starts, pa.array(lengths), content], names)

    return placed.mapInArrow(run, f"`{id_column}` {kind}, start long, n_tokens long, {last}")
