"""Secret scan with multipart credential linking.

Some parts of a credential are telling alone (an access key id, an assignment to a password).
Others are weak: an opaque string, a user name, a host. Weak parts are reported only where the
parts that complete them stand within the same scope, a span of characters around them. The
interval join of parts with scopes is a range window over the parts of a document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_of

# Characters before and after a part in which its complements count.
SCOPE = 300
# Kind, role, whether weak, pattern, least length of the value, and strings of which a
# text (in lower case) must hold one to be searched at all; a cheap test that loses no match. Runs of
# one character class are maximal, so a least length in the pattern equals dropping short runs after.
_LOGIN = ("user", "login", "client_id", "account")
KINDS = [
    (
        "assign", "secret", False,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12, ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    ("access", "identifier", False, r"AKIA[A-Z0-9]{14,}", 18, ("akia",)),
    ("hex", "secret", False, r"[0-9a-f]{16,}", 16, ()),
    ("opaque", "secret", True, r"[A-Za-z0-9+/_-]{24,}", 24, ("akia", *_LOGIN)),
    (
        "login", "identifier", True,
        r"(?i)(?:user|username|login|client_id|account)\x20*[:=]\x20*[A-Za-z0-9_.@-]{3,}", 3, _LOGIN,
    ),
    (
        "endpoint", "endpoint", True,
        r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb)://[^\s\"'<>]{4,}", 8, ("://",),
    ),
]
BASE = ("assign", "access", "hex")
_BLOCK = 256
_ROW = ["__id", "__length", "__hash"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """Sums of all values before each place; blocks keep long arrays from quadratic work."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def within(block: Column, offset: Column) -> Column:
        return F.transform(block, lambda _, i: offset + total(F.slice(block, 1, i)))

    def blocks_of(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(_BLOCK))
        return F.transform(starts, lambda s: F.slice(whole, s + 1, _BLOCK))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, total)
        offsets = _let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, 1, i))))
        return F.flatten(F.zip_with(blocks, offsets, within))

    return _let(values, lambda whole: _let(blocks_of(whole), joined))


def _spans(text: Column, low: Column, order: int) -> Column:
    """Spans of one kind as structs (order, start, end), leftmost first, none overlapping another.

    The pieces between the matches and the matches themselves make up the text, so running sums
    of their lengths are the positions, in code points.
    """
    kind, _, _, pattern, least, signs = KINDS[order]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else matches
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))

    def spans(lengths: Column) -> Column:
        return F.zip_with(
            F.zip_with(_running(lengths), lengths, lambda a, b: a + b),
            F.arrays_zip(matches.alias("m"), measured.alias("g")),
            lambda end, x: F.struct(
                F.lit(order).alias("order"), (end - F.length(x["m"])).alias("start"), end.alias("end"), x["g"].alias("g")
            ),
        )

    def counts(span: Column) -> Column:
        long_enough = F.length(span["g"]) >= least
        if kind != "opaque":
            return long_enough
        return long_enough & span["g"].rlike("[A-Z]") & span["g"].rlike("[a-z]") & span["g"].rlike("[0-9]")

    kept = F.filter(_let(lengths, spans), counts)
    bare = F.transform(kept, lambda s: F.struct(s["order"], s["start"], s["end"]))
    possible = text.rlike(pattern)
    if signs:
        possible = reduce(or_, [F.contains(low, F.lit(sign)) for sign in signs]) & possible
    return F.when(possible, bare).otherwise(F.array().cast("array<struct<order:int,start:int,end:int>>"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """The id and ``spans`` (array of kind, start, end) of every row; positions in code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are reported wherever they stand. A weak secret
    (``opaque``) needs an identifier within ``scope`` characters of its start, a weak identifier
    (``login``) needs a secret, an ``endpoint`` needs both. Spans of different kinds may overlap.
    Null and empty texts have no spans. Rows are judged each on its own; rows that repeat an id
    and its text give as many equal rows. Other columns are not read.
    """
    text = text_of(text_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("__id"), text.alias("text"), F.lower(text).alias("low")).select(
        "__id",
        F.length("text").alias("__length"),
        F.xxhash64("text").alias("__hash"),
        F.concat(*[_spans(F.col("text"), F.col("low"), k) for k in range(len(KINDS))]).alias("spans"),
    )
    # A row without spans stays as one part of no kind; the first part of a row counts it.
    parts = rows.select(*_ROW, F.posexplode_outer("spans").alias("at", "span")).select(
        *_ROW, (F.coalesce("at", F.lit(0)) == 0).cast("long").alias("rows"), "span.*"
    )

    def of(column: int) -> dict[int, object]:
        return {k: kind[column] for k, kind in enumerate(KINDS)}

    role = F.element_at(F.create_map(*[F.lit(x) for kv in of(1).items() for x in kv]), F.col("order"))
    weak = F.element_at(F.create_map(*[F.lit(x) for kv in of(2).items() for x in kv]), F.col("order"))
    around = Window.partitionBy(*_ROW).orderBy("start").rangeBetween(-scope, scope)
    near = {r: F.coalesce(F.max(F.col("role") == r).over(around), F.lit(False)) for r in ("identifier", "secret", "endpoint")}
    linked = parts.withColumns({"role": role, "weak": weak}).withColumns({f"near_{r}": c for r, c in near.items()})
    complete = (
        F.when(F.col("role") == "secret", F.col("near_identifier"))
        .when(F.col("role") == "identifier", F.col("near_secret"))
        .otherwise(F.col("near_identifier") & F.col("near_secret"))
    )
    reported = F.when(~F.col("weak") | complete, F.struct("start", "order", "end"))
    # Rows with one id and text have the same spans; a set holds them once.
    grouped = linked.groupBy(*_ROW).agg(F.sum("rows").alias("rows"), F.sort_array(F.collect_set(reported)).alias("spans"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    named = F.transform(
        "spans", lambda s: F.struct(names[s["order"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return grouped.select(
        F.col("__id").alias(id_column), named.alias("spans"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")
    ).drop("copy")


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col(id_column),
        *[number(kind) for kind in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
