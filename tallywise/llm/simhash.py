"""SimHash near-duplicate detection; fingerprints are compared bit-sliced, block against block.

Fingerprint: A-Z lower-cased, words are maximal runs of ``[^\\x20\\x09-\\x0D]``, shingles are the
``SHINGLE`` consecutive words of every position joined by one space (repeats counted; a text of
fewer words is one shingle of all of them). Each shingle hashes to XXH64 of its UTF-8 bytes with
seed 42 (Spark's ``xxhash64``); bit i of the fingerprint is 1 where over half of the hashes have it.
A text without words has fingerprint 0 and is compared like any other. All of this is Spark
expressions: positions are exploded and 64 bit counts are summed per row, combined map-side.

Links: fingerprints at Hamming distance ``RADIUS`` or less. Candidates: the 64 bits are cut into
four bands of 16; two fingerprints within 2 bits agree on at least two bands, so each distinct
fingerprint is keyed under the six pairs of its bands. Members of one key are dealt into blocks
of at most ``BLOCK``; each pair of blocks is one task, so a crowded key is many bounded tasks.

Method, inside a task: the target block is stored as 64 bit planes, vertically (bit j of word w of
plane b is bit b of target 64w+j). For all queries at once, the planes are XORed with the query's
bit and added into carry-save counters, two bit-words and an overflow word per 64 lanes; a lane
whose count passes the radius is dead, and the block is abandoned once every lane of every query
is dead. Surviving lanes are links, exact. Only links leave the task, never pairs of a key.

Components are taken over distinct fingerprints (equal texts have equal fingerprints and are
linked at distance 0); each document's ``component_id`` is the smallest ``doc_id`` reachable.

Edge cases: null text is empty (fingerprint 0); null ``doc_id`` rows are linked like others but
never name a component (a component of null ids only has a null id); repeated rows each get a
row; only the id and text columns are read, so other columns never clash; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WORD, lowered, small, text_of

# Shingle length, hash seed (Spark's xxhash64 seed), bits, link radius.
SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
# Candidates: four bands of 16 bits, keyed in pairs (any two within RADIUS share two bands).
BANDS, BAND_BITS = 4, 16
PAIRS = [(i, j) for i in range(BANDS) for j in range(i + 1, BANDS)]
# Members of one candidate key compared in one task, at most.
BLOCK = 2048


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint (long; its bits are the SimHash) for every row."""
    words = F.regexp_extract_all(lowered(text_of(text_column)), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("row", F.monotonically_increasing_id())
    starts = (
        F.when(F.col("n") >= SHINGLE, F.sequence(F.lit(0), F.col("n") - SHINGLE))
        .when(F.col("n") > 0, F.array(F.lit(0)))
        .otherwise(F.array().cast("array<int>"))
    )
    placed = rows.select("row", "doc_id", "n", "words", F.explode_outer(starts).alias("at"))
    shingle = F.when(F.col("n") >= SHINGLE, F.concat_ws(" ", F.slice("words", F.col("at") + 1, SHINGLE))).otherwise(
        F.concat_ws(" ", "words")
    )
    hashed = placed.select("row", "doc_id", F.when(F.col("at").isNotNull(), F.xxhash64(shingle)).alias("h"))
    counts = hashed.groupBy("row", "doc_id").agg(
        F.count("h").alias("k"),
        *[F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)],
    )
    bits = [
        F.when(F.lit(2) * F.coalesce(F.col(f"b{i}"), F.lit(0)) > F.col("k"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(
            F.lit(0).cast("long")
        )
        for i in range(BITS)
    ]
    return counts.select("doc_id", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def as_hex(fingerprint: str) -> F.Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(F.col(fingerprint))), 16, "0")


def _planes(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes (64 x words) of targets, 64 lanes a word, and the mask of lanes in use."""
    words = (len(targets) + 63) // 64
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[: len(targets)] = targets
    lanes = padded.reshape(words, 64)
    planes = np.zeros((BITS, words), dtype=np.uint64)
    shifts = np.arange(BITS, dtype=np.uint64)
    for j in range(64):
        bits = (lanes[:, j][None, :] >> shifts[:, None]) & np.uint64(1)
        planes |= bits << np.uint64(j)
    valid = np.zeros(words, dtype=np.uint64)
    full, rest = divmod(len(targets), 64)
    valid[:full] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if rest:
        valid[full] = np.uint64((1 << rest) - 1)
    return planes, valid


def close_pairs(queries: np.ndarray, targets: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (qi, ti) of all query-target pairs within ``radius`` bits, by bit-sliced counting.

    Counters per (query, word of 64 targets): the count's bits (only up to ``radius`` matter) as
    words, and ``dead`` for lanes past the radius. Checks every 8 planes whether all lanes died.
    """
    if len(queries) == 0 or len(targets) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    planes, valid = _planes(targets.astype(np.uint64))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    q = queries.astype(np.uint64)
    levels = max(1, int(radius).bit_length())
    count = [np.zeros((len(q), planes.shape[1]), dtype=np.uint64) for _ in range(levels)]
    dead = np.zeros_like(count[0])
    dead |= ~valid[None, :]
    limit = radius
    for b in range(BITS):
        qmask = np.where((q >> np.uint64(b)) & np.uint64(1), ones, np.uint64(0))
        carry = planes[b][None, :] ^ qmask[:, None]
        for level in range(levels):  # carry-save addition of one bit into the counter's bits
            count[level], carry = count[level] ^ carry, count[level] & carry
        dead |= carry  # overflow beyond the counter's width
        # Lanes whose count exceeds the radius: compare the counter's bits with the radius's.
        above = np.zeros_like(dead)
        equal = np.full_like(dead, ones)
        for level in reversed(range(levels)):
            r = (limit >> level) & 1
            if r:
                equal &= count[level]
            else:
                above |= equal & count[level]
                equal &= ~count[level]
        dead |= above
        if b % 8 == 7 and np.all(dead == ones):
            break
    alive = ~dead
    qi, wi = np.nonzero(alive)
    if len(qi) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lanes = ((alive[qi, wi][:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(bool)
    pq, pl = np.nonzero(lanes)
    return qi[pq].astype(np.int64), (wi[pq] * 64 + pl).astype(np.int64)


def _compare(block):
    """Links of one pair of blocks: side 0 queries, side 1 targets (same block: side 0 only)."""
    import pandas as pd

    queries = block.loc[block["side"] == 0, "fp"].to_numpy(dtype=np.int64)
    targets = block.loc[block["side"] == 1, "fp"].to_numpy(dtype=np.int64)
    same = len(targets) == 0
    if same:
        targets = queries
    qi, ti = close_pairs(queries.view(np.uint64), targets.view(np.uint64))
    a, b = queries[qi], targets[ti]
    keep = a < b if same else a != b
    a, b = a[keep], b[keep]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within RADIUS bits; all of them, each once."""
    distinct = prints.select(F.col("fingerprint").alias("fp")).distinct()
    mask = (1 << BAND_BITS) - 1
    band = [F.shiftright("fp", BAND_BITS * i).bitwiseAND(F.lit(mask)) for i in range(BANDS)]
    keys = F.array(
        *[F.struct(F.lit(c).alias("combo"), F.shiftleft(band[i], BAND_BITS).bitwiseOR(band[j]).alias("key")) for c, (i, j) in enumerate(PAIRS)]
    )
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.combo", "k.key")
    crowded = (
        keyed.groupBy("combo", "key")
        .agg(F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .select("combo", "key", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks"))
    )
    members = keyed.join(crowded, ["combo", "key"]).withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    )
    # A member of block b queries the pairs (b, j), j >= b, and is the target of (i, b), i < b.
    as_query = members.select(
        "combo", "key", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"), "fp"
    ).withColumn("side", F.lit(0))
    as_target = (
        members.filter("block > 0")
        .select("combo", "key", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("lo"), F.col("block").alias("hi"), "fp")
        .withColumn("side", F.lit(1))
    )
    dealt = as_query.unionByName(as_target)
    found = dealt.groupBy("combo", "key", "lo", "hi").applyInPandas(_compare, "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row."""
    from ..sources.workspace import stored

    prints = stored(fingerprints(docs, id_column, text_column), "simhash")
    least = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    linked = components(links(prints)).select(F.col("node").alias("fp"), "component")
    named = linked.join(least, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    labels = linked.join(named, "component").select("fp", "component_id")
    per_print = stored(
        least.join(labels, "fp", "left").select(
            "fp", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
        ),
        "simhash_components",
    )
    joined = prints.join(small(per_print), prints["fingerprint"] == per_print["fp"], "left")
    return joined.select("doc_id", as_hex("fingerprint").alias("fingerprint"), "component_id")


__all__ = ["close_pairs", "fingerprints", "links", "near_duplicates"]
