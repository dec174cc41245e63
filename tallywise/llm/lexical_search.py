"""Ranked lexical search of many queries at once, sharing the work of term sets that queries share.

Scoring (integers after the weight): N documents with a term, L their terms, n a document's
terms, df the documents holding a term, tf its count in the document, all over the whole table.
A term weighs ``w = floor(1000 ln((2N+2)/(2df+1)))``; a document's length norm is
``m = 75 + (25 n N) div L``; it scores ``sum over the query's terms (repeats included) of
w * ((10^9 tf) div (1000 tf + 12 m))``.

Method: multi-query common-subexpression evaluation.

1. Mining shared term sets: every query term gets the signature of the queries that hold it, with
   the term's count in each. Terms of one signature form a *class*: a term set that exactly the same
   queries share, each the same number of times. The signature is a pair of order-free hashes and
   a count; classes whose (class, query) edges do not add up to that count are split into single
   terms, so a hash collision never merges terms.
2. Materialised partial accumulators: each document's partial score for each class is summed
   once, however many queries hold the class (a term in every query costs one posting pass).
3. The query-sharing DAG term -> class -> query combines partials: a query's score is the sum of
   its classes' partials times the term count on the edge.

Postings come from one pass over the documents (Arrow batches): each text is split into terms
once, and only its query terms are kept, as ids with counts, one stored row per document, with no
shuffle. N, L and df are sums over the stored rows. Partials and their combination per query run
inside each task over batches of documents (numpy), and each task keeps only its k best rows per
query, so a query that matches every document sends k rows per task to its final ranking. The
query vocabulary and the edges are broadcast once counted below BROADCAST_TERMS; beyond that the
same result comes from joins and aggregations (``_search_by_joins``).

Edge cases: a null text has no terms and does not count in N; queries without terms, and terms
that no document holds, add nothing; a score of 0 is never returned. Rows repeating a
``doc_id`` are separate documents (each counted, each ranked; equal scores and ids in any order
among themselves). Null ``doc_id`` rank after every id of equal score. Only the id and text
columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import stored
from .shared import lowered, small, text_of

# What a term is (runs of anything but ASCII punctuation, space and controls),
# the constants of the score, and how many documents each query returns.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TF_SCALE, SCORE_SCALE = 1000, 1_000_000_000
K1_X10, B_BASE, B_X100 = 12, 100, 25
TOP = 20


def terms_of(text_column: str) -> F.Column:
    """The terms of a text column: A-Z lower-cased only; null has none."""
    return F.regexp_extract_all(lowered(text_of(text_column)), F.lit(TERM), F.lit(0))


def term_classes(items: DataFrame, item_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(terms, edges): each query term with its class, and each class with its queries and counts.

    Returns ``term, c1, c2, c3, cterm`` and ``c1, c2, c3, cterm, item_id, qtf``.
    """
    counted = (
        items.select(F.col(f"`{item_column}`").alias("item_id"), F.explode(terms_of(text_column)).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    signed = counted.groupBy("term").agg(
        F.bit_xor(F.xxhash64("item_id", "qtf")).alias("c1"),
        F.bit_xor(F.hash("qtf", "item_id").cast("long") * F.lit(0x9E3779B1) + F.lit(1)).alias("c2"),
        F.count(F.lit(1)).alias("c3"),
    )
    edges = counted.join(signed, "term").select("c1", "c2", "c3", "item_id", "qtf").distinct()
    # A class whose edges outnumber its signature's count holds terms of different signatures.
    mixed = edges.groupBy("c1", "c2", "c3").agg(F.count(F.lit(1)).alias("k")).filter("k <> c3")
    signed = signed.join(mixed.select("c1", "c2", "c3", F.lit(True).alias("mixed")), ["c1", "c2", "c3"], "left")
    terms = signed.select(
        "term", "c1", "c2", "c3", F.when(F.col("mixed"), F.col("term")).otherwise(F.lit("")).alias("cterm")
    )
    edges = counted.join(terms, "term").select("c1", "c2", "c3", "cterm", "item_id", "qtf").distinct()
    return terms, edges


def _search_by_joins(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The same result by joins and aggregations only: for query vocabularies beyond the broadcast bound."""
    terms, edges = term_classes(items, item_column, item_text)
    terms = small(terms)
    listed = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), terms_of(text_column).alias("terms"))
    # One pass over the texts: a row of postings per (document row, query term) with its count, and
    # one marker row (null term) per document that carries n. The row number is given before the
    # terms are exploded, in its own projection, so all terms of a row share it.
    asked = terms.select("term", F.lit(True).alias("asked"))
    postings = (
        listed.select("doc_id", F.size("terms").cast("long").alias("n"), "terms")
        .filter("n > 0")
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "n", "row", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
        .join(asked, "term", "left")
        .filter(F.col("asked") | F.col("term").isNull())
        .groupBy("row", "doc_id", "n", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    postings = stored(postings, "postings")
    totals = postings.filter(F.col("term").isNull()).agg(
        F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")
    ).first()
    big_n, big_l = int(totals["N"]), int(totals["L"])
    if big_l == 0:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    postings = postings.filter(F.col("term").isNotNull())
    weights = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = (F.lit(2.0 * big_n + 2.0) / (F.lit(2.0) * F.col("df").cast("double") + F.lit(1.0)))
    weights = weights.select("term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w"))
    weights = small(weights.join(terms, "term"))
    norm = f"({B_BASE - B_X100} + ((CAST({B_X100} AS BIGINT) * n * CAST({big_n} AS BIGINT)) div CAST({big_l} AS BIGINT)))"
    gain = F.expr(f"w * ((CAST({SCORE_SCALE} AS BIGINT) * tf) div ({TF_SCALE} * tf + {K1_X10} * {norm}))")
    # Partial accumulators: one sum per (class, document row), shared by all queries of the class.
    partial = (
        postings.join(weights, "term")
        .groupBy("c1", "c2", "c3", "cterm", "row", "doc_id")
        .agg(F.sum(gain).alias("part"))
    )
    scores = (
        partial.join(small(edges), ["c1", "c2", "c3", "cterm"])
        .groupBy("item_id", "row", "doc_id")
        .agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))
        .filter("score > 0")
    )
    order = Window.partitionBy("item_id").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()
    )
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long"))


def _tokenize(vocabulary):
    """Arrow batches of (row, id, text) to per-document postings of query terms: ids and counts."""
    import re

    import numpy as np
    import pyarrow as pa

    pattern = re.compile(TERM)
    a_to_z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            sizes, tids, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                found = pattern.findall((text or "").translate(a_to_z))
                sizes.append(len(found))
                ids = np.fromiter((known.get(t, -1) for t in found), dtype=np.int32, count=len(found))
                ids, counts = np.unique(ids[ids >= 0], return_counts=True)
                tids.append(ids)
                tfs.append(counts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("id_value"),
                    batch.column("id_null"),
                    pa.array(sizes, pa.int64()),
                    pa.array(tids, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int32())),
                ],
                ["row", "id_value", "id_null", "n", "tids", "tfs"],
            )

    return run


# Entries of (document, class) partials expanded to (document, query) at once in a task, at most.
EXPANDED = 4_000_000


def _score(tables, k: int, big_n: int, big_l: int):
    """Arrow batches of postings to each task's k best rows per query, by the query-sharing DAG."""
    import numpy as np
    import pyarrow as pa

    def top(item, score, null, value, row):
        order = np.lexsort((row, value, null, -score, item))
        item, score, null, value, row = item[order], score[order], null[order], value[order], row[order]
        first = np.r_[True, item[1:] != item[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
        keep = np.arange(len(item)) - start < k
        return item[keep], score[keep], null[keep], value[keep], row[keep]

    def combine(post, weight, cls, edge_start, edge_item, edge_qtf):
        doc, tids, tfs, m = post
        gain = weight[tids] * ((np.int64(1_000_000_000) * tfs) // (np.int64(1000) * tfs + np.int64(12) * m[doc]))
        classes = cls[tids].astype(np.int64)
        # Partial accumulators: one sum per (document, class), however many queries share the class.
        key = doc * np.int64(len(edge_start) - 1) + classes
        key, where = np.unique(key, return_inverse=True)
        partial = np.zeros(len(key), dtype=np.int64)
        np.add.at(partial, where, gain)
        pdoc, pcls = key // (len(edge_start) - 1), key % (len(edge_start) - 1)
        # Combine along the DAG: each partial goes to the queries of its class, times the term count.
        fan = edge_start[pcls + 1] - edge_start[pcls]
        at = np.repeat(edge_start[pcls], fan) + (np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan))
        items = edge_item[at]
        values = np.repeat(partial, fan) * edge_qtf[at]
        key = np.repeat(pdoc, fan) * np.int64(edge_item.max() + 1 if len(edge_item) else 1) + items
        key, where = np.unique(key, return_inverse=True)
        score = np.zeros(len(key), dtype=np.int64)
        np.add.at(score, where, values)
        width = np.int64(edge_item.max() + 1 if len(edge_item) else 1)
        return key // width, key % width, score

    def run(batches):
        weight, cls, edge_start, edge_item, edge_qtf = (np.asarray(a) for a in tables.value)
        fan_of = np.diff(edge_start)
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            rows = batch.column("row").to_numpy()
            values = batch.column("id_value").to_numpy()
            nulls = batch.column("id_null").to_numpy(zero_copy_only=False)
            m = 75 + (np.int64(25) * batch.column("n").to_numpy() * np.int64(big_n)) // np.int64(big_l)
            offsets = batch.column("tids").offsets.to_numpy()
            tids = batch.column("tids").values.to_numpy()
            tfs = batch.column("tfs").values.to_numpy().astype(np.int64)
            lengths = np.diff(offsets)
            doc = np.repeat(np.arange(len(rows), dtype=np.int64), lengths)
            # Documents in chunks whose expansion to queries stays below EXPANDED entries.
            load = np.zeros(len(rows), dtype=np.int64)
            np.add.at(load, doc, fan_of[cls[tids]])
            bounds, total, start = [0], 0, 0
            for i, x in enumerate(load):
                if total + x > EXPANDED and i > start:
                    bounds.append(i)
                    start, total = i, 0
                total += x
            bounds.append(len(rows))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if lo == hi:
                    continue
                a, b = offsets[lo], offsets[hi]
                pdoc, item, score = combine((doc[a:b], tids[a:b], tfs[a:b], m), weight, cls, edge_start, edge_item, edge_qtf)
                good = score > 0
                pdoc, item, score = pdoc[good], item[good], score[good]
                merged = [
                    np.r_[kept[0], item],
                    np.r_[kept[1], score],
                    np.r_[kept[2], nulls[pdoc]],
                    np.r_[kept[3], values[pdoc]],
                    np.r_[kept[4], rows[pdoc]],
                ]
                kept = list(top(*merged))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.bool_()),
             pa.array(kept[3], pa.int64()), pa.array(kept[4], pa.int64())],
            ["item", "score", "id_null", "id_value", "row"],
        )

    return run


# Query terms and (class, query) edges shipped to every executor, at most; beyond, joins do the work.
BROADCAST_TERMS = 1_000_000


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """For every query, its ``k`` best documents: item_id, rank (1..), doc_id, score (long).

    Three passes: (1) each text is split into terms once, in Arrow batches, and only its query
    terms are kept as ids with counts, one stored row per document (no shuffle); (2) df per term
    and N, L are sums over the stored rows; (3) each task sums partials per (document, class) and
    combines them per query along the DAG, keeping its ``k`` best per query; a window over those
    gives the result. The query vocabulary and the edges are broadcast after a count shows they
    are at most BROADCAST_TERMS; beyond, the same result comes from joins (``_search_by_joins``).
    """
    import numpy as np

    spark = docs.sparkSession
    terms, edges = term_classes(items, item_column, item_text)
    terms, edges = stored(terms, "terms"), stored(edges, "edges")
    if terms.count() > BROADCAST_TERMS or edges.count() > BROADCAST_TERMS:
        return _search_by_joins(docs, items, k, id_column, text_column, item_column, item_text)
    listed = sorted((r.term, r.c1, r.c2, r.c3, r.cterm) for r in terms.collect())
    tid = {t[0]: i for i, t in enumerate(listed)}
    class_of, cls = {}, np.zeros(len(listed), dtype=np.int32)
    for i, t in enumerate(listed):
        cls[i] = class_of.setdefault(t[1:], len(class_of))
    edge_rows = edges.collect()
    item_ids = sorted({r.item_id for r in edge_rows}, key=lambda x: (x is None, x))
    item_index = {v: i for i, v in enumerate(item_ids)}
    by_class = sorted((class_of[(r.c1, r.c2, r.c3, r.cterm)], item_index[r.item_id], r.qtf) for r in edge_rows)
    edge_cls = np.array([e[0] for e in by_class], dtype=np.int64)
    edge_start = np.searchsorted(edge_cls, np.arange(len(class_of) + 1)).astype(np.int64)
    edge_item = np.array([e[1] for e in by_class], dtype=np.int64)
    edge_qtf = np.array([e[2] for e in by_class], dtype=np.int64)

    rows = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(0)).alias("id_value"),
        F.col(f"`{id_column}`").isNull().alias("id_null"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    ).withColumn("row", F.monotonically_increasing_id())
    vocabulary = spark.sparkContext.broadcast(tid)
    postings = rows.mapInArrow(
        _tokenize(vocabulary), "row long, id_value long, id_null boolean, n long, tids array<int>, tfs array<int>"
    )
    postings = stored(postings.filter("n > 0"), "postings")
    totals = postings.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    big_n, big_l = int(totals["N"]), int(totals["L"])
    if big_l == 0 or not len(edge_item):
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = postings.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2.0 * big_n + 2.0) / (F.lit(2.0) * F.col("df").cast("double") + F.lit(1.0))
    weight = np.zeros(len(listed), dtype=np.int64)
    for r in df.select("tid", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w")).collect():
        weight[r.tid] = r.w
    tables = spark.sparkContext.broadcast((weight, cls, edge_start, edge_item, edge_qtf))
    found = postings.mapInArrow(
        _score(tables, k, big_n, big_l), "item long, score long, id_null boolean, id_value long, row long"
    )
    names = spark.createDataFrame(
        [(i, v) for i, v in enumerate(item_ids)],
        T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", edges.schema["item_id"].dataType)]),
    )
    doc_id = F.when(F.col("id_null"), F.lit(None).cast("long")).otherwise(F.col("id_value"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id_null"), F.col("id_value"), F.col("row"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ranked = ranked.join(F.broadcast(names), "item")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score")


__all__ = ["TERM", "TOP", "search", "term_classes", "terms_of"]
