"""SimHash and components against brute force."""

import collections
import random
import re

import numpy as np
import xxhash

from hearth.llm import simhash
from hearth.llm.components import components
from hearth.llm.queries import QUERIES
from tests.llm.util import docs, sample_docs, tables_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text, k=3):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def brute_components(rows, max_bits=2):
    fps = [brute_fp(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    c, least = classes(len(rows), pairs), {}
    for (i, _), x in zip(rows, c):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [(i, f, least.get(x)) for (i, _), f, x in zip(rows, fps, c)]


def near_copies():
    r = random.Random(5)
    base = ["w%d" % r.randrange(500) for _ in range(400)]
    out = [(i, f"text {i} " + " ".join(r.choices(base, k=i % 9))) for i in range(300)]
    for i in range(300, 380):
        w = list(base)
        w[r.randrange(400)] = "changed%d" % r.randrange(20)
        out.append((i, " ".join(w).upper() if i % 2 else "\t".join(w)))
    return out


def test_query_against_brute_force(spark, tmp_path):
    df = sample_docs(spark).unionByName(docs(spark, [(i + 50_000, t) for i, t in near_copies()]))
    d = tables_dir(tmp_path, spark, documents=df)
    got = QUERIES["op9_simhash_pivots"](spark, d).collect()
    want = brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, f"{f:016x}", c) for i, f, c in want)
    sizes = collections.Counter(r.component_id for r in got)
    assert max(sizes.values()) > 10


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"Word{i}" for i in range(3000)).encode()
    monkeypatch.setattr(simhash, "word_chunks", lambda data: iter([data.split()[i:i + 7] for i in range(0, 3000, 7)]))
    assert simhash.fingerprint(text) == brute_fp(text.decode())


def test_forests_link_what_brute_force_links():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 6, dtype=np.uint64)
    mask = simhash.masks(2)[0]
    free = [b for b in range(64) if not mask >> b & 1]
    fps = set()
    for x in base[:1]:
        for _ in range(900):
            y = int(x) & mask
            for b in r.choice(free, r.integers(0, 9), replace=False):
                y |= 1 << int(b)
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = classes(len(fps), [(i, j) for i, j in zip(*np.nonzero(close)) if i < j])
    table = simhash.forest_by_table(fps, 2, simhash.reference_fingerprints())
    probes = simhash.forest_by_probes(fps, 2, mask, step=37)
    for pairs in (table, probes):
        assert all(close[a, b] for a, b in pairs) and len(pairs) < len(fps)
        assert classes(len(fps), pairs) == want
    assert 1 < len(set(want)) < len(fps)


def test_masks_keep_every_pair():
    r = random.Random(1)
    for max_bits in (0, 1, 2, 3):
        for _ in range(200):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), max_bits):
                y ^= 1 << b
            assert any(x & m == y & m for m in simhash.masks(max_bits))


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(60)] + [(7, 7), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = dict(map(tuple, components(df).collect()))
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {2000: 2000, 2001: 2000}
    assert components(df.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (0, None), (0, None), (5, "quite another text"), (None, "a b c d"), (None, "alone here now ok")]
    got = simhash.keep_one(docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(1, "a b c d"), (0, None), (5, "quite another text"), (None, "alone here now ok")])
    assert simhash.keep_one(docs(spark, rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
