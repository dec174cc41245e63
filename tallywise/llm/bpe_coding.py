"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 32 bytes cuts texts into chunks whose boundaries depend on content alone, so
passages that documents share fall into the same chunks wherever they stand. The words settled
inside a chunk (those that do not touch its edges) are encoded once and reused by the chunk's
hash. At each join the words that touch the boundary are encoded anew; white space ends every
merge, so from the next settled word on both encodings agree and the repair is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import ship_package
from .buffers import Texts, kept_between_tasks, slices, texts_of
from .vocab import IdPool, WordEncoder, encoder, places

# Bytes the rolling hash sees; chunks average 2**CHUNK_BITS bytes.
WINDOW, CHUNK_BITS = 32, 9
# Characters of the opening passage by which documents are brought together.
LOCALITY_CHARS = 256


def chunk_bounds(texts: Texts) -> np.ndarray:
    """Byte positions where chunks begin, with the end of the last; every text begins a chunk."""
    n = len(texts.data)
    at = np.arange(max(0, n - WINDOW + 1))
    rolling = texts.spans_hash(at, at + WINDOW)
    cuts = np.flatnonzero((rolling & np.uint64((1 << CHUNK_BITS) - 1)) == 0) + WINDOW
    return np.unique(np.concatenate([texts.offsets, cuts[cuts < n]]))


class ChunkEncoder:
    """Encodes texts through a pool of chunks, and their joins through the words' own pool."""

    def __init__(self, words: WordEncoder):
        self.words, self.chunks = words, IdPool()

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        starts, ends, owner = texts.words()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts.offsets) - 1, np.int64)
        bounds = chunk_bounds(texts)
        chunk = np.searchsorted(bounds, starts, "right") - 1
        settled = (starts > bounds[chunk]) & (ends < bounds[chunk + 1])
        inner, first = np.unique(chunk[settled], return_index=True)
        first = np.flatnonzero(settled)[first]
        keys = texts.spans_hash(bounds[inner], bounds[inner + 1])
        self.chunks.make_room(len(keys))
        found = self.chunks.find(keys)
        if len(missing := np.flatnonzero(found < 0)):
            _, once = np.unique(keys[missing], return_index=True)
            new = np.sort(missing[once])
            mine = np.flatnonzero(settled & np.isin(chunk, inner[new]))
            ids, counts = self.words.pool.ids(self.words.entries(texts, starts[mine], ends[mine]))
            per_chunk = np.bincount(np.searchsorted(inner[new], chunk[mine]), weights=counts, minlength=len(new))
            self.chunks.add(keys[new], ids, per_chunk.astype(np.int64))
            found = self.chunks.find(keys)
        joins = np.flatnonzero(~settled)
        entries = self.words.entries(texts, starts[joins], ends[joins])
        # Insides of chunks and repaired joins, in the order of their first words.
        inside, repair = self.chunks.ids(found), self.words.pool.ids(entries)
        order = np.argsort(np.concatenate([first, joins]), kind="stable")
        counts = np.concatenate([inside[1], repair[1]])
        at = np.empty(len(counts), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        ids = np.empty(int(counts.sum()), np.uint32)
        ids[places(at[: len(first)], inside[1])] = inside[0]
        ids[places(at[len(first) :], repair[1])] = repair[0]
        text = owner[np.concatenate([first, joins])]
        return ids, np.bincount(text, weights=counts, minlength=len(texts.offsets) - 1).astype(np.int64)


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's chunk encoder for a vocabulary file."""
    return ChunkEncoder(encoder(path))


kept_between_tasks(chunk_encoder.cache_clear)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


@lru_cache(maxsize=2)
def _spellings(path: str) -> tuple[pa.Array, pa.Array]:
    """Per id: its decimal number, and its token."""
    words = encoder(path)
    tokens = [words.tokenizer.id_to_token(i) or "" for i in range(words.size)]
    return pa.array(map(str, range(words.size)), pa.string()), pa.array(tokens, pa.string())


def _spaced(lists: pa.Array, spelling: pa.Array) -> pa.Array:
    """Each list's ids spelled and joined by one space."""
    # Spelled ids stay below the 2 GB that a Spark string may hold.
    spelled = pc.take(spelling, lists.values)
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()), spelled), " ")


def decoded(lists: pa.Array, vocabulary: str) -> pa.Array:
    """The text of each list of ids, special tokens included; the vocabulary's decoder joins tokens by spaces."""
    return _spaced(lists, _spellings(vocabulary)[1])


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.binary())], pa.string())


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids`` (array<int>), one row per row; null and empty texts have no ids.

    Rows with equal ids or texts are encoded each on its own, other columns are not read, and a
    null id is kept. ``vocabulary`` is the path of a tokenizer file, readable by every executor.
    """
    return _coded(docs, vocabulary, id_column, text_column, "ids array<int>", lambda lists: [lists.cast(pa.list_(pa.int32()))])


def encode_digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What ``encode`` and ``decode`` give, as digests: n_tokens, ids_sha256 and decoded_sha256."""

    def digests(lists: pa.Array) -> list[pa.Array]:
        numbers = _spaced(lists, _spellings(vocabulary)[0])
        return [pc.list_value_length(lists).cast(pa.int64()), _sha256(numbers), _sha256(decoded(lists, vocabulary))]

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, vocabulary, id_column, text_column, schema, digests)


def _coded(docs, vocabulary, id_column, text_column, schema, finish) -> DataFrame:
    """Encode all rows; documents with equal opening passages meet in a task, where their chunks are shared.

    The rebalancing by opening passage is for reuse only: Spark splits a large group among tasks,
    each of which then encodes a shared chunk once.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    opening = F.xxhash64(F.substring("text", 1, LOCALITY_CHARS))
    near = rows.withColumn("opening", opening).hint("rebalance", "opening").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", keep=True):
            ids, counts = chunk_encoder(vocabulary).encode(texts_of(batch.column(1)))
            columns = finish(_lists(ids, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_column, *names])

    names = [part.split()[0] for part in schema.split(", ")]
    return near.mapInArrow(run, f"`{id_column}` {kind}, {schema}")


def decode(encoded: DataFrame, vocabulary: str, ids_column: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of an array of ids; null ids give an empty text."""
    ship_package(encoded.sparkSession)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        filled = pc.fill_null(ids.cast(pa.large_list(pa.int32())), [])
        return decoded(filled, vocabulary).cast(pa.string())

    return encoded.withColumn("decoded", text(F.col(ids_column)))
