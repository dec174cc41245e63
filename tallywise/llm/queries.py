"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Query, read_table
from ..sources.workspace import fresh_path
from . import (
    bpe_coding,
    exact_dedup,
    filter_audit,
    fingerprints,
    html_extraction,
    lexical_search,
    mixing,
    ngram_join,
    secret_scan,
    simhash,
    substring_dedup,
    token_output,
    toxicity,
)

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """The public vocabulary's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read_table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read_table(spark, sf_dir, "documents"), digest=True)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_ids(read_table(spark, sf_dir, "documents"), path, vocabulary())
    return token_output.read_ids(spark, path, digest=True)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_order(mixing.mix(read_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels), kept=("doc_id",))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op8_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_coding.encode_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read_table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH texts AS (SELECT doc_id, {_NORMAL} AS content FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(content) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY content)
"""

OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         sha256(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source
),
rates AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM sources
),
common AS (
  SELECT coalesce(arg_min(rate, source_size / weight) FILTER (WHERE 3 * source_size >= rate * weight), 0) AS rate FROM rates
),
targets AS (
  SELECT r.source, r.source_size, least(3.0::DOUBLE * r.source_size, c.rate * r.weight) AS target FROM rates r, common c
),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, goal - ahead)) + greatest(0, least(size, goal - ahead - source_size))
         + greatest(0, least(size, goal - ahead - 2 * source_size)) AS taken
FROM placed
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = rf"""
WITH listed AS (
  SELECT row_number() OVER () AS row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n
  FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0
),
totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM listed),
asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
postings AS (
  SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM listed)
  WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * big_n + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, big_n
),
scored AS (
  SELECT a.item_id, p.row, p.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * t.big_n) // t.big_l)))) AS BIGINT) AS score
  FROM asked a JOIN postings p ON a.term = p.term JOIN weights w ON w.term = p.term, totals t
  GROUP BY a.item_id, p.row, p.doc_id
),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP13_SQL = r"""
WITH f AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
m AS (
  SELECT doc_id, part,
         (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM f
),
marks AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT m.part, m.mask, count(*) AS n,
         count(*) FILTER (WHERE marks.good = 1) AS good, count(*) FILTER (WHERE marks.toxic = 1) AS toxic
  FROM m LEFT JOIN marks ON m.doc_id = marks.doc_id GROUP BY m.part, m.mask
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS filter, bits[s] AS bit,
         list_sum(bits[1:s]) - bits[s] AS earlier
  FROM orders, range(1, 6) r(s)
),
parts AS (SELECT part, sum(n) AS total FROM counts GROUP BY part),
done AS (
  SELECT p.part, s.filter_order, s.step, s.filter,
         CAST(p.total - coalesce(sum(c.n) FILTER (WHERE (c.mask & (s.earlier + s.bit)) <> 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(c.n) FILTER (WHERE (c.mask & s.bit) <> 0 AND (c.mask & s.earlier) = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(c.n) FILTER (WHERE (c.mask & s.bit) <> 0 AND (c.mask & s.earlier) <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(c.n) FILTER (WHERE c.mask = s.bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(c.good) FILTER (WHERE (c.mask & s.bit) <> 0 AND (c.mask & s.earlier) = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(c.toxic) FILTER (WHERE (c.mask & s.bit) <> 0 AND (c.mask & s.earlier) = 0), 0) AS BIGINT) AS toxic_lost
  FROM parts p CROSS JOIN steps s LEFT JOIN counts c ON c.part = p.part
  GROUP BY p.part, p.total, s.filter_order, s.step, s.filter
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM done
"""

QUERIES: dict[str, Query] = {
    "op1_secret_scan": Query(op1_secret_scan, None),
    "op2_exact_dedup": Query(op2_exact_dedup, OP2_SQL),
    "op3_token_output": Query(op3_token_output, None),
    "op4_source_mixing": Query(op4_source_mixing, OP4_SQL),
    "op5_toxicity": Query(op5_toxicity, None),
    "op6_ngram_join": Query(op6_ngram_join, None),
    "op7_substring_dedup": Query(op7_substring_dedup, None),
    "op8_bpe_coding": Query(op8_bpe_coding, None),
    "op9_fingerprints": Query(op9_fingerprints, None),
    "op10_html_extraction": Query(op10_html_extraction, None),
    "op11_lexical_search": Query(op11_lexical_search, OP11_SQL),
    "op12_simhash_dedup": Query(op12_simhash_dedup, None),
    "op13_filter_audit": Query(op13_filter_audit, OP13_SQL),
}
