"""Consistent weighted sampling against the similarity that it estimates, and the edited texts against brute force."""

import collections
import hashlib
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from hearth.llm import fingerprints
from hearth.llm.queries import QUERIES
from tests.llm.util import SF, docs, sample_docs

CLASHES = {"lang": "_block", "source": "_text"}


def words(text):
    return collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")))


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def brute(rows):
    """rows: (doc_id, text), in order; n_chars, sha of the edited text, exact similarities."""
    out = {}
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(words(t), words(edited)), jaccard(words(t), words(nxt)))
    return out


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(4)
    pairs = []
    for i in range(40):
        a = collections.Counter({f"w{j}": r.choice([1, 1, 2, 5, 40]) for j in range(r.randint(1, 60))})
        b = collections.Counter({w: max(c + r.choice([-1, 0, 0, 3]), 1) for w, c in a.items() if r.random() < .8})
        b.update({f"v{j}": r.choice([1, 2, 7]) for j in range(r.randint(0, 40))})
        pairs.append((a, b))
    text = lambda c: " ".join(r.sample(list(c.elements()), sum(c.values())))
    rows = [(2 * i + s, text(c)) for i, p in enumerate(pairs) for s, c in enumerate(p)]
    got = {x.doc_id: x.fp for x in fingerprints.fingerprints(docs(spark, rows), samples=400).collect()}
    off = [statistics.mean(x == y for x, y in zip(got[2 * i], got[2 * i + 1])) - jaccard(a, b) for i, (a, b) in enumerate(pairs)]
    assert max(map(abs, off)) < 0.11 and abs(statistics.mean(off)) < 0.012  # four deviations of 400 samples; 40 x 400 in the mean


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_edited_against_brute_force(spark, blocks):
    df = sample_docs(spark).filter("doc_id NOT IN (10004)")
    rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = fingerprints.edited_fingerprints(df.withColumnsRenamed(CLASHES).repartition(5), blocks=blocks).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: w[:2] for i, w in want.items()}
    off = [r.near_edited - want[r.doc_id][2] for r in got] + [r.near_next - want[r.doc_id][3] for r in got]
    assert abs(statistics.mean(off)) < 0.01 and max(map(abs, off)) < 0.3
    by_words = collections.defaultdict(set)
    for r in got:
        by_words[frozenset(words(dict(rows)[r.doc_id]).items())].add(r.fingerprint)
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * fingerprints.SAMPLES
    assert all(len(f) == 1 for f in by_words.values()) and len(set.union(*by_words.values())) == len(by_words)


def test_repeated_rows_and_keys(spark):
    """Equal keys follow each other by hash, equal rows are interchangeable; every row is there."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g"), (2, "same text"), (2, "same text"), (None, "null key"), (None, None), (3, "")]
    got = fingerprints.edited_fingerprints(docs(spark, rows * 20).repartition(7), blocks=8).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t or "")) for i, t in rows * 20)
    twos = [r for r in got if r.doc_id == 2]
    assert sum(r.near_next == 1.0 for r in twos) == 39 and sum(r.near_next == 1.0 for r in got if r.doc_id == 3) >= 19


def test_order_does_not_change_results(spark):
    df = sample_docs(spark)
    a, b = (sorted(map(tuple, fingerprints.edited_fingerprints(x, blocks=n).collect()), key=str) for x, n in ((df, 5), (df.orderBy(F.rand(3)).repartition(9), 40)))
    assert a == b


def test_empty_table_and_single_row(spark):
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    one = fingerprints.edited_fingerprints(docs(spark, [(5, "ab cd ef")])).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(5, 8, hashlib.sha256(b"ab cab c").hexdigest(), 1.0)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    q = QUERIES["op12_consistent_sampling"](spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan) and plan.count("Exchange hashpartitioning") == 1
    got, want = q.collect(), brute(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: w[:2] for i, w in want.items()}
    # 64 samples have a variance of at most 0.25 / 64; the mean over 200 documents varies by a tenth.
    assert statistics.mean((r.near_edited - want[r.doc_id][2]) ** 2 for r in got) < 1.3 * 0.25 / 64
    assert statistics.mean((r.near_next - want[r.doc_id][3]) ** 2 for r in got) < 1.3 * 0.25 / 64
