"""Mixing: posteriors, the fit against its optimum, rounding."""

import collections

import numpy as np
from pyspark.sql import functions as F

from hearth.llm import mixing
from hearth.llm.common import stored
from hearth.llm.queries import MIX_KEEP, MIX_WEIGHTS, QUERIES, label_domains
from tests.llm.util import DOCS, SF, docs, sample_docs, tables_dir

SF1 = "/root/testdata/sf0.01"


def test_query_meets_its_targets(spark):
    got = QUERIES["op1_soft_mixing"](spark, SF1).collect()
    assert len(got) == 1000 and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    t, r = np.array([x.n_tokens for x in got]), np.array([x.rate for x in got])
    p = np.array([[x.p_good, x.p_low, x.p_toxic] for x in got])
    assert np.allclose(p.sum(axis=1), 1)
    have, expected = t @ p, (t * r) @ p
    w = np.array([MIX_WEIGHTS[k] for k in ("good", "low", "toxic")])
    want = w / w[0] * have[0]
    assert np.abs(expected - want).max() < 1e-4 * want.sum()
    assert np.allclose(got[0].totals, expected) and np.allclose(got[0].targets, want)
    drawn = (t * np.array([x.copies for x in got])) @ p
    assert abs(drawn.sum() / want.sum() - 1) < 0.05


def test_posteriors_follow_the_labels(spark):
    """Held-out rows that are low or toxic, not both, by their domain; those that are both go to either of the two."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    dom = label_domains(labels)
    both = labels.filter("toxic = 1 AND quality = 0").select("doc_id").withColumn("both", F.lit(True))
    fit_on, test = dom.filter("doc_id % 3 > 0"), dom.filter("doc_id % 3 = 0").join(both, "doc_id", "left")
    got = mixing.posteriors(d, fit_on, ["good", "low", "toxic"]).join(test, "doc_id").collect()
    best = collections.Counter((bool(r.both), r.domain, ["good", "low", "toxic"][int(np.argmax(r.p))]) for r in got)
    for k in ("good", "low", "toxic"):
        own = sum(n for (x, a, _), n in best.items() if a == k and not x)
        assert best[False, k, k] / own > 0.85, best
    assert best[True, "toxic", "good"] <= 0.1 * sum(n for (x, _, _), n in best.items() if x)


def test_fit_tells_how_it_ended(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    rows = stored(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(r.integers(1, 500, 400), p)], "n_tokens bigint, p array<double>"), "mix-test")
    for want, weights, rounds in (("targets", [0.4, 0.3, 0.3], 120), ("unsettled", [0.9999, 5e-5, 5e-5], 4)):
        steps, totals, targets = mixing.fit_rates(rows, weights, 0, max_rounds=rounds, tolerance=1e-3)
        assert mixing.fit_state(totals, targets, len(steps), rounds, 1e-3) == want
    assert mixing.fit_state(np.array([9.0, 1.0]), np.array([8.0, 1.0]), 50, 120) == "nearest"
    assert {x.fit for x in QUERIES["op1_soft_mixing"](spark, SF).select("fit").distinct().collect()} <= {"targets", "nearest"}


def test_fit_reaches_the_constrained_optimum(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    t = r.integers(1, 500, 400)
    rows = stored(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens bigint, p array<double>").repartition(4), "mix-test")
    steps, totals, targets = mixing.fit_rates(rows, [0.9, 0.08, 0.02], 0)
    rate = mixing._rates(p, steps)[0]
    assert (rate >= 0).all() and (rate == 0).any()
    assert np.allclose(totals, (rate * t) @ p)
    # These targets are out of reach; at the nearest point no document's rate can move to gain.
    step = p @ ((totals - targets) / (t @ p))
    assert np.abs(step[rate > 0]).max() < 1e-3 and step[rate == 0].min() > -1e-3


def test_edges(spark):
    w = {"a": 0.5, "b": 0.5}
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    df = sample_docs(spark, 10)
    got = mixing.mix(df, none, w, "a").collect()
    assert len(got) == 22 and {tuple(r.p) for r in got} == {(0.5, 0.5)} and all(abs(r.rate - 1) < 1e-9 for r in got)
    one = spark.createDataFrame([(10_001, "a"), (10_005, "a"), (1, "unknown"), (None, "b")], "doc_id bigint, domain string")
    assert {tuple(r.p) for r in mixing.mix(df, one, w, "a").collect()} == {(1.0, 0.0)}
    two = spark.createDataFrame([(10_004, "a"), (10_006, "b"), (10_006, "b")], "doc_id bigint, domain string")
    three = {"a": 0.5, "b": 0.25, "c": 0.25}
    got = mixing.mix(df, two, three, "a").collect()
    assert len(got) == 22 and all(len(r.p) == 3 and r.p[2] == 0 and np.isfinite(r.rate) for r in got)
    assert len({(r.rate, r.copies) for r in got if r.doc_id == 10_004}) == 1
    assert mixing.mix(docs(spark, []), two, w, "a").count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")]), one, w, "a").count() == 2


def test_apply(spark, tmp_path):
    df = docs(spark, [(1, "x y"), (2, None), (3, "z"), (4, "w"), (4, "w")])
    mixed = df.selectExpr("doc_id", "xxhash64(text) AS text_hash", "CASE doc_id WHEN 1 THEN 0 WHEN 3 THEN 3 ELSE 1 END AS copies")
    got = collections.Counter(r.doc_id for r in mixing.apply_mix(df, mixed).collect())
    assert got == {2: 1, 3: 3, 4: 2}
    assert mixing.apply_mix(df, mixed).schema == spark.createDataFrame([], DOCS).schema
    assert QUERIES["op1_soft_mixing"](spark, tables_dir(tmp_path, spark, documents=sample_docs(spark, 30))).count() == 42
