"""N-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles. Similar documents are put into groups; the matrix says
which tokens occur in which group. A document can only be similar to a member of a group if
enough of its tokens are in the group's union, so it looks at the tokens of the union first and
opens only the groups that reach the bound. Groups come from links that were found and verified
before, so that inside a group nothing is left to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import ship_package, stored
from .buffers import mixed, shingles, slices, texts_of
from .components import components
from .shared import small, with_group

WORDS = 5
PERCENT = 75
# Sketches: hash minima per document, in bands of ROWS; documents that agree on a band are tried as a group.
BANDS, ROWS = 10, 3
# Members of a group that one task holds.
BLOCK = 512
# Groups, one document of each, whose tokens tell which tokens are common: so many, and this share at least.
# Common tokens are looked up last.
SAMPLE_DOCS, SAMPLE_SHARE = 10_000, 1 / 8
COMMON_IN_SAMPLE, COMMON_TOKENS = 4, 1_000_000
# While the matrix makes more pairs of groups than this per group, a token of more than CROWDED groups
# is made common, too, and the matrix built anew.
PAIRS, CROWDED = 64, 32


def _needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap with a set of n tokens, of any set that is similar to it."""
    return -(-n * PERCENT // 100)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def _sketches(rows: DataFrame) -> DataFrame:
    """Per row: number of shingles, two sums that identify the set, and a key per band."""
    generator = np.random.default_rng(11)
    factors = generator.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, values, count = shingles(texts_of(batch.column(1), lower=True), WORDS)
            filled = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[filled]
            content = np.zeros((2, len(count)), np.uint64)
            keys = np.zeros((len(count), BANDS), np.int64)
            if len(filled):
                content[0, filled] = np.add.reduceat(values, first)
                content[1, filled] = np.add.reduceat(mixed(values ^ np.uint64(0xA5A5A5A5)), first)
                for band in range(BANDS):
                    key = np.full(len(filled), band, np.uint64)
                    for f in factors[band * ROWS : (band + 1) * ROWS]:
                        key = mixed(key + np.minimum.reduceat(values * f, first))
                    keys[filled, band] = key.view(np.int64)
            offsets = pa.array(np.arange(len(count) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count.astype(np.int64)),
                    pa.array(content[0].view(np.int64)),
                    pa.array(content[1].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                ],
                ["id", "n", "s1", "s2", "bands"],
            )

    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>")


def _verified(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Links (a, b) of tasks (group, id, query): every query against the members of its group.

    ``rows`` are documents (id, text), one per set. A task first holds a group's members, at most about BLOCK of
    them, and their union of tokens; queries then stream by. A query with fewer tokens in the
    union than it needs is passed over, others are counted against all members at once.
    """
    tasks = stored(tasks.distinct(), "tasks")
    wanted = tasks.groupBy("id").agg(F.collect_list(F.struct("group", "query")).alias("roles"))
    texts = rows.join(small(stored(wanted, "wanted")), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, values, count = shingles(texts_of(batch.column(1), lower=True), WORDS)
            ends = np.cumsum(count)
            raw = [values[e - n : e].tobytes() for e, n in zip(ends.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(raw, pa.binary())], ["id", "roles", "tokens"]
            )

    roles = "array<struct<group:bigint,query:boolean>>"
    held = texts.select("id", "text", "roles").mapInArrow(sets, f"id long, roles {roles}, tokens binary")
    dealt = held.select("id", "tokens", F.explode("roles").alias("role")).select("role.group", "role.query", "id", "tokens")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "query", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, matrix = None, [], None
        for batch in batches:
            a, b = [], []
            for at, query, doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if at != group:
                    group, members, matrix = at, [], None
                tokens = np.frombuffer(raw, np.uint64)
                if not query:
                    members.append((doc, tokens))
                    continue
                if matrix is None:
                    matrix = _matrix(members)
                for found in _similar(matrix, doc, tokens):
                    a.append(doc)
                    b.append(found)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _matrix(members: list[tuple[int, np.ndarray]]):
    """A group's members as token-ordered columns: its union, where each token's members begin, the members."""
    ids = np.array([i for i, _ in members], np.int64)
    sizes = np.array([len(t) for _, t in members], np.int64)
    tokens = np.concatenate([t for _, t in members]) if members else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(tokens, kind="stable")
    union, first = np.unique(tokens[order], return_index=True)
    return ids, sizes, union, np.append(first, len(tokens)), owner[order]


def _similar(matrix, doc: int, tokens: np.ndarray) -> list[int]:
    ids, sizes, union, first, owner = matrix
    if not len(union):
        return []
    place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
    place = place[union[place] == tokens]
    if len(place) < _needed(len(tokens)):  # the group's bound
        return []
    starts, counts = first[place], first[place + 1] - first[place]
    ends = np.cumsum(counts)
    hits = owner[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]))]
    shared = np.bincount(hits, minlength=len(ids))
    alike = 100 * shared >= PERCENT * (len(tokens) + sizes - shared)
    return [int(i) for i in ids[alike] if i != doc]


def _common_tokens(rows: DataFrame, count: int) -> np.ndarray:
    """Tokens that many of ``count`` documents have, told by a sample; only the order of look-ups depends on it."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(count, 1)))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(10**12)) < int(share * 10**12))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, values, _ = shingles(texts_of(batch.column(1), lower=True), WORDS)
            value, times = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["token", "times"])

    counted = sample.mapInArrow(tokens, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    common = counted.filter(F.col("times") >= COMMON_IN_SAMPLE).orderBy(F.desc("times"), "token").limit(COMMON_TOKENS)
    return np.sort(common.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def _prefix_tokens(labelled: DataFrame, common: np.ndarray) -> DataFrame:
    """The matrix of (token, group) over the tokens that a similar pair cannot both avoid.

    Of n tokens in a fixed order, rare ones first, two similar sets share one among the first
    n - needed + 1 of each. A batch gives one row per token and group, with the range of sizes.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "text"):
            owner, values, count = shingles(texts_of(batch.column(1), lower=True), WORDS)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                order = np.lexsort((values, known[at] == values, owner))
                owner, values = owner[order], values[order]
            rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            kept = rank <= count[owner] - _needed(count[owner])
            groups = batch.column(2).to_numpy()[owner[kept]]
            sizes, tokens = count[owner[kept]].astype(np.int64), values[kept].view(np.int64)
            order = np.lexsort((sizes, groups, tokens))
            groups, sizes, tokens = groups[order], sizes[order], tokens[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(tokens)) - 1
            arrays = [tokens[first], groups[first], sizes[first], sizes[last] if len(first) else sizes[:0]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["token", "group", "least", "most"])

    return labelled.mapInArrow(run, "token long, group long, least long, most long")


def _shared_tokens(matrix: DataFrame) -> DataFrame:
    """The matrix's tokens that several groups have; one shuffle by token merges rows and compares groups."""
    merged = matrix.repartition("token").groupBy("token", "group")
    merged = merged.agg(F.min("least").alias("least"), F.max("most").alias("most"))
    by_token = Window.partitionBy("token").orderBy("group")
    beside = F.coalesce(F.lag("group").over(by_token), F.lead("group").over(by_token))
    return merged.withColumn("beside", beside).filter("beside IS NOT NULL").drop("beside")


def _block(id_column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), blocks)


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, and component_id, the smallest id reachable by links.

    A text's set holds its distinct runs of WORDS words, A-Z lowered; with fewer words it holds
    the whole sequence; texts without words are empty and linked with nothing. Two documents
    link when their sets' intersection is at least PERCENT hundredths of their union. Equal sets
    are compared once. No link between different sets is left out. Ids are whole numbers; rows
    that repeat an id stand for one document each and share its component; a null id is never
    linked. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = _rows(docs, id_column, text_column)
    sketches = stored(_sketches(rows), "sketches")
    usable = sketches.filter("n > 0 AND id IS NOT NULL")
    content = ["n", "s1", "s2"]
    least = {"rep": F.min("id")}
    counted = with_group(usable.select("id", *content), content, "id", least, {"rep": F.min("rep")})
    reps = stored(counted.select("id", *content, "rep").distinct(), "reps")
    one = reps.filter("id = rep").select("id", "n")
    # One text per set, and of each row of that id only one.
    chosen = usable.join(one.select("id"), "id", "left_semi").groupBy("id").agg(F.first("bands").alias("bands"))
    chosen = stored(chosen, "chosen")
    unique = rows.dropDuplicates(["id"]) if sketches.count() != sketches.select("id").distinct().count() else rows

    # Groups: documents that agree on a band of minima, each against one document of the band.
    keyed = chosen.select("id", F.explode("bands").alias("key"))
    # A hash of id and band picks the one, so that a document meets different ones in its bands.
    picked = F.min(F.struct(F.xxhash64("id", "key").alias("order"), F.col("id").alias("id")))
    anchors = with_group(keyed, ["key"], "id", {"anchor": picked}, {"anchor": F.min("anchor")})
    anchors = anchors.withColumn("anchor", F.col("anchor.id"))
    pairs = anchors.filter("anchor <> id").select("anchor", "id").distinct()
    salt = _block("id", F.lit(16))
    tasks = pairs.select(F.xxhash64("anchor", salt).alias("group"), "id", "anchor")
    roles = tasks.select("group", "id", F.lit(True).alias("query")).unionByName(
        tasks.select("group", F.col("anchor").alias("id"), F.lit(False).alias("query"))
    )
    star = stored(_verified(unique, roles), "star")
    groups = stored(components(star), "groups")

    # The matrix's groups: linked documents, and with them those that agree with one of them on a
    # band but are not linked. The latter are compared with all of their group below.
    at_anchor = pairs.join(small(groups).withColumnRenamed("node", "anchor"), "anchor", "left")
    nearest = F.coalesce(F.min("component"), F.min("anchor"))
    around = stored(at_anchor.groupBy("id").agg(nearest.alias("around")), "around")
    labelled = one.select("id").join(small(groups).withColumnRenamed("node", "id"), "id", "left").join(small(around), "id", "left")
    labelled = labelled.select("id", F.coalesce("component", "around", "id").alias("group"), F.col("component").isNull().alias("alone"))
    labelled = stored(labelled, "labelled")
    # Tokens meet group by group, so a group counts once.
    heads = stored(labelled.filter("id = group").select("id"), "heads")
    n_groups = heads.count()
    common = _common_tokens(unique.join(small(heads), "id", "left_semi"), n_groups)
    while True:
        texts = unique.join(small(labelled), "id").select("id", "text", "group")
        shared = stored(_shared_tokens(_prefix_tokens(texts, common)), "matrix")
        held = shared.groupBy("token").count()
        if (held.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] or 0) <= PAIRS * n_groups:
            break
        crowded = held.filter(F.col("count") > CROWDED).orderBy(F.desc("count"), "token").limit(COMMON_TOKENS)
        crowded = crowded.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
        more = np.setdiff1d(crowded, common)[: max(0, COMMON_TOKENS - len(common))]
        if not len(more):
            break
        common = np.union1d(common, more)
    a, b = shared.alias("a"), shared.alias("b")
    meeting = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.group") < F.col("b.group")))
    meeting = meeting.groupBy(F.col("a.group").alias("x"), F.col("b.group").alias("y")).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.least(F.min("a.least"), F.min("b.least")).alias("least"),
        F.greatest(F.max("a.most"), F.max("b.most")).alias("most"),
        F.max("a.most").alias("x_most"),
        F.max("b.most").alias("y_most"),
        F.min("a.least").alias("x_least"),
        F.min("b.least").alias("y_least"),
    )
    sizes_fit = (F.col("x_least") * PERCENT <= F.col("y_most") * 100) & (F.col("y_least") * PERCENT <= F.col("x_most") * 100)
    # Of sizes a >= b, an overlap of p / (1 + p) of a + b is needed, and less than p of a lies beyond
    # the looked-up tokens of either side; so the looked-up tokens alone must share the difference.
    enough = F.col("tokens") * (100 * (100 + PERCENT)) > PERCENT * (100 * F.col("least") - PERCENT * F.col("most"))
    meeting = stored(meeting.filter(sizes_fit & enough).select("x", "y"), "meeting")

    # The smaller group's members are the queries, the larger one is opened block by block; and a
    # group's members without a link ask their own group.
    sizes = stored(labelled.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max("alone").alias("alone")), "sizes")
    sized = meeting.join(sizes.select(F.col("group").alias("x"), F.col("size").alias("sx")), "x")
    sized = sized.join(sizes.select(F.col("group").alias("y"), F.col("size").alias("sy")), "y")
    smaller = F.col("sx") < F.col("sy")
    sized = sized.select(
        F.when(smaller, F.col("x")).otherwise(F.col("y")).alias("asking"),
        F.when(smaller, F.col("y")).otherwise(F.col("x")).alias("opened"),
        F.greatest("sx", "sy").alias("size"),
    )
    own = sizes.filter("alone AND size > 1").select(F.col("group").alias("asking"), F.col("group").alias("opened"), "size")
    opening = sized.unionByName(own).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).drop("size")
    each = opening.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asking = each.join(labelled.withColumnRenamed("group", "asking"), "asking").filter("asking <> opened OR alone").select(
        F.xxhash64("opened", "block").alias("group"), "id", F.lit(True).alias("query")
    )
    opened = opening.select("opened", "blocks").distinct().join(labelled.withColumnRenamed("group", "opened"), "opened")
    opened = opened.select(
        F.xxhash64("opened", _block("id", F.col("blocks"))).alias("group"), "id", F.lit(False).alias("query")
    )
    crossing = stored(_verified(unique, asking.unionByName(opened)), "crossing")

    final = stored(components(star.unionByName(crossing)), "components")
    placed = reps.select("id", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("id", F.coalesce("component", "rep").alias("component_id"))
    result = sketches.select("id", "n").join(placed.groupBy("id").agg(F.min("component_id").alias("component_id")), "id", "left")
    return result.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that no link ties to a smaller id, with their columns unchanged."""
    found = join(docs, id_column, text_column)
    dropped = stored(found.filter(f"component_id < `{id_column}`").select(F.col(id_column).alias("__id")), "dropped")
    return docs.join(small(dropped), docs[id_column] == F.col("__id"), "left_anti")
