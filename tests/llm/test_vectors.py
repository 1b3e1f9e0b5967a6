"""Vector codes and hard negatives against brute force, SQL and odd tables."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import hard_negatives, vector_codes
from hearth.llm.queries import ORACLES, QUERIES
from tests.llm.util import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, row_id string, key string, q string, code string, score int, slot int"


def table(spark, rows):
    """rows: (vec_id, embedding, label); the other columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 1, 2) for r in rows], SCHEMA)


def usable(rows, n):
    return [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
            if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]


def vectors(n, dim=8, seed=3, labels=4):
    r = random.Random(seed)
    pool = [[np.float32(r.randint(-6, 6) / 16 + r.choice([0, .001])).item() for _ in range(dim)] for _ in range(n // 3)]
    rows = [(i, r.choice(pool), r.choice([*range(labels), None])) for i in range(n)]
    return rows + [(7, pool[0], 1), (7, pool[0], 1), (None, pool[1], 2), (n, None, 1), (n + 1, [1.0] * (dim - 1) + [math.nan], 1),
                   (n + 2, [1.0] * (dim - 1) + [None], 1), (n + 3, [math.inf] * dim, 1), (n + 4, [0.5] * (dim + 4), 1), (n + 5, [], 1)]


def brute_codes(rows, dim, parts, entries, rounds):
    kept = usable(rows, dim)
    d = dim // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * d:(p + 1) * d] for _, v, _ in order] for p in range(parts)]

    def best(part, p):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [collections.defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                part = v[p * d:(p + 1) * d]
                at[p][best(part, p)[1]].append(part)
        books = [[[sum(c) // len(at[p][e]) for c in zip(*at[p][e])] if e in at[p] else old for e, old in enumerate(books[p])] for p in range(parts)]
    out, by_label = [], collections.Counter()
    for i, v, c in kept:
        found = [best(v[p * d:(p + 1) * d], p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), c))
        by_label[c] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, c, e, by_label[lab], sha) for i, c, e, lab in out)


@pytest.mark.parametrize("parts, entries, scale", [(4, 8, 1), (2, 300, 1), (8, 5, 1), (4, 8, 2.0 ** 40)])
def test_codes_against_brute_force(spark, parts, entries, scale):
    rows = [(i, v and [x if x is None else x * scale for x in v], c) for i, v, c in vectors(90)]
    if entries > 256:
        with pytest.raises(ValueError):
            vector_codes.vector_codes(table(spark, rows), entries=entries)
        entries = 200
    if scale > 1:  # squared distances beyond a long are refused, not wrong
        with pytest.raises(Exception, match="does not fit a long|overflow"):
            vector_codes.vector_codes(table(spark, rows), parts=parts, entries=entries).collect()
        rows = [(i, v, 1) for i, v, c in rows if v is None or len(set(v)) == 1][:1] + [(0, [2.0 ** 50] * 8, 1), (1, [2.0 ** 50 + 2 ** 30] * 8, 1)]
    df = table(spark, rows).repartition(5)
    got = collections.Counter(map(tuple, vector_codes.vector_codes(df, parts=parts, entries=entries, rounds=2).collect()))
    assert got == brute_codes([(i, v and [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows], 8, parts, entries, 2)


def test_trie_shares_and_is_exact():
    r = np.random.default_rng(1)
    for dim, n in ((1, 50), (4, 20_000), (6, 300)):
        parts, entries = r.integers(-9, 9, (n, dim)), r.integers(-9, 9, (64, dim))
        trie, code, far = vector_codes.nearest(parts, entries)
        want = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code[trie.leaf] == want.argmin(axis=1)).all() and (far[trie.leaf] == want.min(axis=1)).all()
        assert trie.weight.sum() == n and len(trie.rows) == len({tuple(p) for p in parts.tolist()})
        assert sum((trie.split <= j).sum() for j in range(dim)) < n * dim  # nodes that are visited, against all rows in all dimensions


def test_codes_decode(spark):
    codes, books = vector_codes.compress(table(spark, vectors(90)), parts=4, entries=64)
    got = codes.collect()
    near = vector_codes.decode([r.code for r in got], books)
    kept = {i: v for i, v, _ in usable(vectors(90), 8)}
    assert all(sum((a - b) ** 2 for a, b in zip(kept[r.key], v)) == r.error for r, v in zip(got, near) if r.key != 7)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)]])
def test_codes_of_nothing(spark, rows):
    got = vector_codes.vector_codes(table(spark, rows)).collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(i, "00" * 16, 0) for i, v, _ in rows if v == []]
    assert hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 2 == 0).count() == 0


def brute_negatives(rows, dim, every, positives=5, negatives=5):
    kept = [r for r in usable(rows, dim) if r[2] is not None]
    out = collections.Counter()
    for n, (a, va, la) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i is None, i or 0, i, c) for m, (i, v, c) in enumerate(kept) if m != n]
        for ps, _, _, p, c in sorted((s for s in scored if s[4] == la), key=lambda s: s[:3])[:positives]:
            window = sorted((s for s in scored if s[4] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps), key=lambda s: s[:3])
            out.update((a, p, k + 1, s[3], -ps, -s[0]) for k, s in enumerate(window[:negatives]))
    return out


@pytest.mark.parametrize("wave_bytes", [8 << 20, 8 * 8 * 20])
def test_negatives_against_brute_force(spark, wave_bytes, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = vectors(240, seed=5)
    got = hard_negatives.hard_negatives(table(spark, rows).repartition(6), F.col("vec_id") % 5 == 0, wave_bytes=wave_bytes)
    want = brute_negatives(rows, 8, 5)
    assert collections.Counter(map(tuple, got.collect())) == want and len(want) > 200


def test_negatives_with_hot_copies(spark):
    """Half of all rows are one vector; ties go by id, copies of an anchor are positives."""
    rows = [(i, [0.5, 0.25, -0.5, 0.75], i % 3) for i in range(300)] + vectors(300, 4, seed=9)[:300]
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert collections.Counter(map(tuple, got.collect())) == brute_negatives(rows, 4, 50)


def test_large_scores():
    a = np.array([[2.0 ** 33, 3.0], [1.0, 2.0 ** 70]])
    with pytest.raises(OverflowError):
        hard_negatives.scores(a, a)
    assert hard_negatives.scores(np.array([[2.0 ** 40, -(2.0 ** 22)]]), np.array([[2.0 ** 22, 2.0 ** 40]])).tolist() == [[0]]


@pytest.mark.parametrize("shape", [(33, 17, 45), (100, 35, 63), (1, 1, 1), (64, 64, 64), (40, 70, 1)])
def test_strassen(shape):
    r = np.random.default_rng(2)
    m, k, n = shape
    a, b = r.integers(-2 ** 25, 2 ** 25, (m, k)), r.integers(-2 ** 25, 2 ** 25, (n, k))
    assert (hard_negatives.strassen(a, b, 4) == a @ b.T).all()
    assert (hard_negatives.strassen(a.astype(object), b.astype(object), 4) == a @ b.T).all()


@pytest.mark.parametrize("name", ["op11_trie_codes", "op13_strassen_negatives"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert got.columns == rel.columns
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(rel.fetchall())
