"""How five quality filters interact: every order of applying them, and each filter's Shapley share.

The filters, by letter (a document *fails* a filter when the condition holds):

* A: fewer than ``MIN_WORDS`` words;
* B: ``100 * distinct words < DISTINCT_PCT * words``;
* C: ``100 * [A-Z] characters > UPPER_PCT * code points``;
* D: holds any of ``[#$%&*|]``;
* E: identical to the text of a row with a smaller ``doc_id``, table-wide.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive; a null text is empty.

Method: exact constrained least squares over coalitions. A pass over the rows gives each row's
failure pattern (five bits); the rows are counted per (part, pattern), which a map-side combine
does before any shuffle. From the 32 pattern counts of a part the removals of all 32 coalitions
follow: v(S) = rows failing any filter of S. The Shapley value of each filter is the solution of
the kernel-weighted least squares fit of v over all coalitions, constrained so that the values add
up to v(all); its normal equations are solved in rationals, so the result is exact. The counts of
each step of an order are differences of coalitions: removed at step k = v(first k) - v(first k-1).
Per part one small task sees 32 rows and writes 600; no row of the corpus goes through the driver.

Edge cases: a null ``lang`` is the part ``""``; a null text is empty and fails A (and not B, C, D);
null ``doc_id`` rows never fail E and make no other row fail it; rows repeating both ``doc_id`` and
text are each counted and neither fails E by the other; labels repeated for one ``doc_id`` count
by their largest value, and a row without labels is neither good nor toxic. An empty table gives
no rows. Only ``doc_id``, ``text`` and ``lang`` are read, so other columns never clash.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, small, text_of, with_group

# The filters' letters and thresholds.
LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PCT = 80
UPPER_PCT = 10
SYMBOLS = r"[#$%&*|]"

ORDERS = ["".join(p) for p in permutations(LETTERS)]
RESULT = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per document: part, the pattern of failed filters (bit i for LETTERS[i]), good, toxic."""
    text = text_of("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        (F.size(words) < MIN_WORDS).alias("a"),
        (100 * F.size(F.array_distinct(words)) < DISTINCT_PCT * F.size(words)).alias("b"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > UPPER_PCT * F.length(text)).alias("c"),
        text.rlike(SYMBOLS).alias("d"),
        F.length(text).alias("size"),
        F.sha2(text, 256).alias("digest"),
    )
    # E: the smallest doc_id of the same text, brought back to the rows in parts (a hot text is split).
    rows = with_group(
        rows,
        ["size", "digest"],
        "doc_id",
        {"least": F.min("doc_id")},
        {"least": F.min("least")},
    ).withColumn("e", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    pattern = sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate("abcde")), F.lit(0))
    rows = rows.select("doc_id", "part", pattern.alias("pattern"))
    if labels is None:
        return rows.withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality").cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic"),
    )
    marked = rows.join(small(marks.filter(F.col("doc_id").isNotNull())), "doc_id", "left")
    return marked.select(
        "doc_id",
        "part",
        "pattern",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def coalition_counts(rows: DataFrame) -> DataFrame:
    """Per part and pattern: documents, good ones, toxic ones; the partial sums are map-side."""
    return rows.groupBy("part", "pattern").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("good") == 1).cast("long")).alias("good"),
        F.sum((F.col("toxic") == 1).cast("long")).alias("toxic"),
    )


def shapley_values(value: dict[int, int], players: int = len(LETTERS)) -> list[Fraction]:
    """Shapley values of a game given on all coalitions (bit masks), by the constrained kernel fit.

    Minimise sum_S k(S) (v(S) - v(0) - sum_{i in S} phi_i)^2 over the coalitions S other than the
    empty and the full one, with k(S) = (p-1) / (C(p,|S|) |S| (p-|S|)), subject to
    sum phi_i = v(full) - v(0). Lagrange's normal equations are solved in rationals.
    """
    p, full = players, (1 << players) - 1
    gram = [[Fraction(0)] * p for _ in range(p)]
    right = [Fraction(0)] * p
    for mask in range(1, full):
        size = bin(mask).count("1")
        weight = Fraction(p - 1, comb(p, size) * size * (p - size))
        members = [i for i in range(p) if mask >> i & 1]
        gain = Fraction(value.get(mask, 0) - value.get(0, 0))
        for i in members:
            right[i] += weight * gain
            for j in members:
                gram[i][j] += weight
    # [gram 1; 1' 0] [phi; lambda] = [right; total]
    system = [gram[i] + [Fraction(1)] + [right[i]] for i in range(p)]
    system.append([Fraction(1)] * p + [Fraction(0), Fraction(value.get(full, 0) - value.get(0, 0))])
    return _solve(system)[:p]


def _solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """Gauss-Jordan elimination of an augmented matrix in rationals."""
    n = len(rows)
    for col in range(n):
        pivot = next(r for r in range(col, n) if rows[r][col] != 0)
        rows[col], rows[pivot] = rows[pivot], rows[col]
        head = rows[col][col]
        rows[col] = [x / head for x in rows[col]]
        for r in range(n):
            if r != col and rows[r][col] != 0:
                factor = rows[r][col]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[col])]
    return [rows[r][n] for r in range(n)]


def _part_report(part: str, counts) -> list[tuple]:
    """The 600 rows of one part from its pattern counts (pattern -> (n, good, toxic))."""
    total = sum(c[0] for c in counts.values())

    def removed_by(mask: int, which: int) -> int:
        return sum(c[which] for pattern, c in counts.items() if pattern & mask)

    full = (1 << len(LETTERS)) - 1
    v = {mask: removed_by(mask, 0) for mask in range(full + 1)}
    good = {mask: removed_by(mask, 1) for mask in range(full + 1)}
    toxic = {mask: removed_by(mask, 2) for mask in range(full + 1)}
    phi = shapley_values(v)
    orders = len(ORDERS)
    shapley = []
    for i in range(len(LETTERS)):
        share = phi[i] * orders
        if share.denominator != 1:
            raise ArithmeticError("a Shapley share over all orders is not whole")
        shapley.append(int(share))
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, start=1):
            bit = 1 << LETTERS.index(letter)
            after = before | bit
            removed = v[after] - v[before]
            out.append(
                (
                    part,
                    order,
                    step,
                    letter,
                    total - v[after],
                    removed,
                    v[bit] - removed,
                    v[full] - v[full & ~bit],
                    good[after] - good[before],
                    toxic[after] - toxic[before],
                    shapley[LETTERS.index(letter)],
                )
            )
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; see the module's docstring."""
    import pandas as pd

    columns = [f.split()[0] for f in RESULT.split(", ")]

    def report(counts: pd.DataFrame) -> pd.DataFrame:
        part = counts["part"].iloc[0]
        table = {
            int(r.pattern): (int(r.n), int(r.good), int(r.toxic)) for r in counts.itertuples(index=False)
        }
        return pd.DataFrame(_part_report(part, table), columns=columns)

    counts = coalition_counts(failures(docs, labels))
    return counts.groupBy("part").applyInPandas(report, RESULT)


__all__ = ["LETTERS", "ORDERS", "audit", "coalition_counts", "failures", "shapley_values"]
