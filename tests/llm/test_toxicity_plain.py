"""Operator 5 against plain computations: the FTRL learner coordinate by coordinate, and every
document's score as the logistic of its distinct buckets' weights, text by text."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tallywise.llm import toxicity


def plain_ftrl(rows, labels, rate=1.0, smooth=1.0, l1=3.0, l2=0.1, epochs=4):
    """FTRL-proximal with per-coordinate rates, written with dictionaries; the bias has no L1."""
    z, n = {}, {}
    bias = toxicity.BUCKETS

    def weight(j):
        zj = z.get(j, 0.0)
        slack = 0.0 if j == bias else l1
        if abs(zj) <= slack:
            return 0.0
        return -(zj - math.copysign(slack, zj)) / ((smooth + math.sqrt(n.get(j, 0.0))) / rate + l2)

    order = np.random.default_rng(7).permutation
    for _ in range(epochs):
        for i in order(len(rows)):
            at = [int(j) for j in rows[i]] + [bias]
            w = {j: weight(j) for j in at}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values())))))
            g = p - labels[i]
            for j in at:
                nj = n.get(j, 0.0)
                sigma = (math.sqrt(nj + g * g) - math.sqrt(nj)) / rate
                z[j] = z.get(j, 0.0) + g - sigma * w[j]
                n[j] = nj + g * g
    weights = {j: weight(j) for j in z if j != bias}
    return {j: v for j, v in weights.items() if v != 0.0}, weight(bias)


def test_learner_is_plain_ftrl():
    rng = np.random.default_rng(11)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))).astype(np.int32) for _ in range(300)]
    labels = np.array([1.0 if (r < 8).sum() >= 2 else 0.0 for r in rows])
    used, weights, bias = toxicity.fit(rows, labels)
    want, want_bias = plain_ftrl(rows, labels)
    assert sorted(used.tolist()) == sorted(want)
    assert dict(zip(used.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert bias == pytest.approx(want_bias, rel=1e-9)


def test_scores_are_the_logistic_of_each_text_alone(spark, small_dir, odd, odd_pairs):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    table = np.zeros(toxicity.BUCKETS)
    table[model["buckets"]] = model["weights"]

    def plain(text):
        _, bucket, _ = toxicity.features(pa.array([text], pa.string()))
        logit = table[np.unique(bucket)].sum() + model["bias"]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, kept=("doc_id",)).collect()}
    assert got == pytest.approx({i: plain(t) for i, t in texts.items()}, rel=1e-9, abs=1e-12)
    odd_scores = sorted(r.score for r in toxicity.score(odd, model, kept=("doc_id",)).collect())
    assert odd_scores == pytest.approx(sorted(plain(t) for _, t in odd_pairs), rel=1e-9, abs=1e-12)
