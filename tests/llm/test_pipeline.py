"""The pipeline stage by stage against plain Python, on the smallest tables."""

from collections import Counter, defaultdict

import plain
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallywise.llm import mixing, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """The documents before each stage, and the rows after the last."""
    docs, held = spark.read.parquet(f"{small_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        held.append(docs)
        docs = corpus_pipeline.stored(stage(spark, docs, small_dir), name)
    return [*held, docs]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) in (4, 5)
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go(spark, small_dir, stages):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    scored = toxicity.score(stages[0], toxicity.train(stages[0], labels), kept=("doc_id",)).collect()
    assert ids(stages[1]) == sorted(r.doc_id for r in scored if r.score < 0.7)


def test_copies_go(stages):
    last = {}
    for doc_id, text in pairs(stages[1]):
        key = (text or "").translate(plain.A_TO_Z)
        last[key] = max(doc_id, last.get(key, doc_id))
    assert ids(stages[2]) == sorted(last.values())


def test_near_copies_go(stages):
    assert ids(stages[3]) == sorted(i for i, _, first in plain.linked(pairs(stages[2])) if i == first)


def test_sources_are_mixed(stages):
    sizes, source = {}, {}
    for r in stages[3].collect():
        sizes[r.doc_id], source[r.doc_id] = len(plain.WORD.findall(r.text or "")), r.source
    used = Counter(ids(stages[4]))
    assert set(used) <= set(sizes) and max(used.values()) <= 3
    targets = {r.doc_id: r.target for r in mixing.mix(stages[3], whole=True).collect()}
    taken, largest = defaultdict(int), defaultdict(int)
    for doc_id, size in sizes.items():
        taken[source[doc_id]] += used[doc_id] * size
        largest[source[doc_id]] = max(size, largest[source[doc_id]])
    for doc_id, target in targets.items():
        assert abs(taken[source[doc_id]] - target) <= largest[source[doc_id]] / 2 + 1


def test_texts_are_encoded(stages, tokenizer):
    want = sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in pairs(stages[4]))
    rows = stages[5].collect()
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_empty_and_null_documents_pass(spark, small_dir):
    schema = spark.read.parquet(f"{small_dir}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a few words", None, None, 11)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, small_dir), name)
        assert set(r.doc_id for r in docs.collect()) <= {1, 2, 3}
