"""Operators 11 to 13 against plain Python: ranked search, SimHash near copies, the filter audit."""

from fractions import Fraction
from itertools import permutations

import numpy as np
import plain
import pytest

from tallywise.llm import filter_audit, lexical_search, simhash
from tallywise.llm.queries import QUERIES


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def documents_of(spark, small_dir, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select(*columns).collect()]


# 11: ranked lexical search


def test_search_query(spark, small_dir):
    docs = documents_of(spark, small_dir, "doc_id", "text")
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows_of(QUERIES["op11_lexical_search"].run(spark, small_dir), "item_id", "rank", "doc_id", "score")
    assert got == ordered(plain.search(docs, items))


def test_search_of_odd_rows(spark, odd, odd_pairs):
    items = spark.createDataFrame(
        [(1, "ONE two"), (2, "word word token"), (3, None), (4, "x" * 50_000), (5, "zzz"), (6, "Σίσυφος don't")],
        "item_id long, text string",
    )
    got = rows_of(lexical_search.search(odd, items), "item_id", "rank", "doc_id", "score")
    assert got == ordered(plain.search(odd_pairs, [tuple(r) for r in items.collect()]))


def test_search_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(3, "a b"), (1, "a b"), (2, "a b"), (2, "a b"), (None, "a b"), (5, "c")] + [(10 + i, "c d") for i in range(30)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, "a"), (8, "c c")], "item_id long, text string")
    got = rows_of(lexical_search.search(docs, items), "item_id", "rank", "doc_id", "score")
    assert got == ordered(plain.search([tuple(r) for r in docs.collect()], [(7, "a"), (8, "c c")]))
    assert [r[2] for r in sorted(got) if r[0] == 7] == [1, 2, 2, 3, None]
    assert len([r for r in got if r[0] == 8]) == 20


def test_shared_term_classes(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "a b d d"), (3, "a b")], "item_id long, text string")
    terms, edges = lexical_search.term_classes(items)
    classes = {}
    for r in terms.collect():
        classes.setdefault((r.c1, r.c2, r.c3, r.cterm), set()).add(r.term)
    assert sorted(map(sorted, classes.values())) == [["a", "b"], ["c"], ["d"]]
    assert sorted(r.qtf for r in edges.collect()) == [1, 1, 1, 1, 2]


def test_search_of_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(nothing.limit(0), nothing.select("id", "text").withColumnRenamed("id", "item_id")).count() == 0


# 12: SimHash


def test_kernel_finds_every_close_pair():
    rng = np.random.default_rng(7)
    targets = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    queries = targets.copy()
    for i in range(0, 300, 2):
        queries[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    for i in range(0, 300, 3):
        queries[i] ^= np.uint64(3) << np.uint64(rng.integers(0, 62))
    qi, ti = simhash.close_pairs(queries, targets)
    want = {(i, j) for i in range(300) for j in range(300) if bin(int(queries[i] ^ targets[j])).count("1") <= 2}
    assert set(zip(qi.tolist(), ti.tolist())) == want
    assert len(simhash.close_pairs(queries[:0], targets)[0]) == 0


def test_simhash_query(spark, small_dir):
    docs = documents_of(spark, small_dir, "doc_id", "text")
    got = rows_of(QUERIES["op12_simhash_dedup"].run(spark, small_dir), "doc_id", "fingerprint", "component_id")
    assert got == ordered(plain.simhash_components(docs))


def test_simhash_of_odd_rows(odd, odd_pairs):
    got = rows_of(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id")
    assert got == ordered(plain.simhash_components(odd_pairs))


def test_simhash_links_edits_and_keeps_others_apart(spark):
    base = " ".join(f"w{i}" for i in range(300))
    edited = base.replace("w150", "changed")
    respaced = base.upper().replace(" ", "\t\n ")
    rows = [(5, base), (9, respaced), (4, edited), (2, "other words entirely " * 40), (None, base), (7, None), (8, ""), (5, base)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id long")
    got = rows_of(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id")
    assert got == ordered(plain.simhash_components([(d, t) for d, t in rows]))
    assert {r[2] for r in got if r[0] in (5, 9)} == {5}
    assert [r for r in got if r[0] in (7, 8)] == [(7, "0" * 16, 7), (8, "0" * 16, 7)]


def test_simhash_of_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


# 13: filter audit


def test_shapley_fit_is_the_average_over_orders():
    rng = np.random.default_rng(3)
    value = {m: int(rng.integers(0, 1000)) if m else 0 for m in range(32)}
    phi = filter_audit.shapley_values(value)
    for i in range(5):
        total = Fraction(0)
        for order in permutations(range(5)):
            before = 0
            for j in order:
                if j == i:
                    total += value[before | 1 << j] - value[before]
                    break
                before |= 1 << j
        assert phi[i] == total / 120


COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_query(spark, small_dir):
    docs = documents_of(spark, small_dir, "doc_id", "text", "lang")
    labels = [tuple(r) for r in spark.read.parquet(f"{small_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = rows_of(QUERIES["op13_filter_audit"].run(spark, small_dir), *COLUMNS)
    assert got == ordered(plain.audit(docs, labels))


def test_audit_of_odd_rows(spark, odd, odd_pairs):
    words = " ".join(f"w{i}" for i in range(120))
    extra = [(20, words, "en"), (21, words, "en"), (19, words.upper(), None), (22, words + " #", "en"), (None, words, "en"), (21, words, "en")]
    df = odd.select("doc_id", "text", "lang", "id", "score").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, lang string").selectExpr("*", "7L AS id", "0.5D AS score")
    )
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 1), (22, 1, 1), (None, 1, 1), (21, None, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(filter_audit.audit(df, labels), *COLUMNS)
    assert got == ordered(plain.audit([tuple(r) for r in df.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.collect()]))
    assert len(got) == 600 * len({r[0] for r in got})


def test_audit_of_empty_table(nothing):
    assert filter_audit.audit(nothing).count() == 0
