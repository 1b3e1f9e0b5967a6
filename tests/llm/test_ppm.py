"""PPM scores against a trie in plain Python, and the unigram base."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import ppm
from hearth.llm.queries import QUERIES
from tests.llm.util import SF, docs, sample_docs, tables_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Trie:
    def __init__(self, order):
        self.order, self.nodes = order, collections.defaultdict(collections.Counter)

    def learn(self, data):
        b = b"\xff" * self.order + data + b"\xfe"
        for i in range(self.order, len(b)):
            for k in range(self.order + 1):
                self.nodes[b[i - k:i]][b[i]] += 1

    def score(self, data):
        b, total = b"\xff" * self.order + data + b"\xfe", 0.0
        for i in range(self.order, len(b)):
            out = set()
            for k in range(self.order, -1, -1):
                node = {s: n for s, n in self.nodes.get(b[i - k:i], {}).items() if s not in out}
                t = sum(node.values())
                if b[i] in node:
                    total += math.log10((2 * node[b[i]] - 1) / (2 * t))
                    break
                if node:
                    total += math.log10(len(node) / (2 * t))
                    out |= set(node)
            else:
                total -= math.log10(255 - len(out))
        return total


def brute(rows, order=ppm.ORDER):
    trie, count = Trie(order), collections.Counter()
    for i, t in rows:
        if not held(i):
            trie.learn(lower(t).encode())
            count.update(WORD.findall(lower(t)) + [None])
    n, v = sum(count.values()), len(count)
    memo, out = {}, []
    for i, t in rows:
        w = WORD.findall(lower(t)) + [None]
        if t not in memo:
            memo[t] = trie.score(lower(t).encode())
        out.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), memo[t]))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 3))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-5, atol=1e-5)


def test_query_against_brute_force(spark, tmp_path):
    df = sample_docs(spark, 60).repartition(3)
    got = QUERIES["op10_ppm_scores"](spark, tables_dir(tmp_path, spark, documents=df)).collect()
    same(got, brute([(r.doc_id, r.text) for r in df.collect()]))


def train():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


@pytest.mark.parametrize("order", [2, 3])
def test_many_chunks_and_hot_rows(spark, order):
    df = docs(spark, [(i, f"text number {i} of the lot " * (i % 5)) for i in range(120)] + [(7, "a hot row " * 5)] * 90).repartition(4)
    got = ppm.ppm_scores(df, train(), order=order, chunk_bytes=600)
    want = brute([(r.doc_id, r.text) for r in df.collect()], order)
    same(got.collect(), want)
    rows, n = ppm._chunked(df, "doc_id", "text", train(), 600)
    per = rows.filter("_key = 7").groupBy("chunk").count().collect()
    assert n > 8 and len(per) >= 4


def test_edges(spark):
    assert ppm.ppm_scores(docs(spark, []), train()).count() == 0
    none = ppm.ppm_scores(docs(spark, [(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in none} == {(1, True, 2, 0, 0), (2, True, 1, 0, 0)}
    assert all(math.isclose(r.base_score, 0, abs_tol=1e-12) for r in none)
    assert {round(r.score, 4) for r in none} == {round(-3 * math.log10(255), 4), round(-math.log10(255), 4)}
    with pytest.raises(ValueError):
        ppm.ppm_scores(docs(spark, []), train(), order=9)


def test_probabilities_sum_to_one():
    trie = Trie(3)
    data = [b"abracadabra", b"abraham", b"", b"cad"]
    for d in data:
        trie.learn(d)
    g = np.concatenate([ppm.grams(d, 3) for d in data])
    codes, counts = np.unique(g, return_counts=True)
    three, at = np.unique(codes & 0xFFFFFF, return_inverse=True)
    low = ppm.LowOrders(three, np.bincount(at, counts))
    for context in (b"bra", b"\xff\xff\xff", b"xyz", b"xab"):
        c = int.from_bytes(context) << 8
        own = np.array([c | s for s in range(255)])
        both = np.unique(np.concatenate([codes, own]))
        n = np.zeros(len(both), np.int64)
        n[np.searchsorted(both, codes)] = counts
        p = 10 ** ppm.gram_scores(both, n, low, 3)[np.searchsorted(both, own)]
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_adaptive_mode():
    assert ppm.adaptive_score(b"", 3) == pytest.approx(-math.log10(255))
    assert ppm.adaptive_score(b"abc" * 40, 3) / 121 > ppm.adaptive_score(bytes(range(40, 160)), 3) / 121 + 1
    # What was learnt from the first half predicts the second.
    one = ppm.adaptive_score(b"the cat sat on the mat. ", 4)
    assert ppm.adaptive_score(b"the cat sat on the mat. " * 2, 4) - one > one / 2


def test_beats_the_base_on_held_out_text(spark):
    r = QUERIES["op10_ppm_scores"](spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert r[2] > 500 and r[0] > r[1]
