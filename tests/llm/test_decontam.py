"""FM-index and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from hearth.llm import decontam
from hearth.llm.fm_index import FMIndex, suffix_array
from hearth.llm.queries import QUERIES
from tests.llm.util import SF, docs, sample_docs, tables_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a:a + size])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                o = windows.get(tuple(w[a:a + n]))
                if o:
                    hit |= set(range(a, a + n))
                    found |= {str(x) for x in o if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def planted(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    odd = [(1, item), (2, None), (3, ""), (4, "--"), (None, "lonely phrase"), (5, "a b a b a b a b a b a b"), (5, "Ünï cödé"), (6, "One two three four five six seven eight nine ten other end")]
    rows = [(90_001, "before " + item.upper().replace(" ", "--") + " after"), (90_002, "x a b a b a b a b a b a b a b a y"),
            (90_003, "one two three four five six seven eight nine ten"), (90_004, "a lonely, phrase. ünï  CÖdé ünÏ"), (90_005, item + " " + item[4:])]
    return docs(spark, rows), spark.createDataFrame(odd, "item_id bigint, text string")


@pytest.mark.parametrize("prune", [True, False])
def test_query_against_brute_force(spark, tmp_path, prune, monkeypatch):
    rows, items = planted(spark)
    items = items.unionByName(spark.read.parquet(f"{SF}/benchmark.parquet"))
    df = sample_docs(spark).unionByName(rows).repartition(3)
    d = tables_dir(tmp_path, spark, documents=df, benchmark=items)
    want = collections.Counter(brute([(r.doc_id, r.text) for r in df.collect()], [tuple(r) for r in items.collect()]))
    if prune:
        got = QUERIES["op6_fm_index_decontamination"](spark, d).drop("spans")
    else:
        got = decontam.find_hits(df, decontam.collect_items(items), prune=False, shard_bytes=20_000)
        got = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (got.n_hit > 0))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sum(x[-1] for x in want) > 5


def test_queries_index_every_word(spark, monkeypatch):
    from corpus_pipeline import decontamination_stage
    used, real, sizes = [], decontam._map_shards, []
    monkeypatch.setattr(decontam, "_map_shards", lambda docs, text, items, window, prune, *rest: used.append(prune) or real(docs, text, items, window, prune, *rest))
    QUERIES["op6_fm_index_decontamination"](spark, SF)
    decontamination_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert used == [False, False]
    monkeypatch.setattr(decontam, "FMIndex", lambda symbols: sizes.append(int((symbols > 0).sum())) or FMIndex(symbols))
    phrases = decontam.Phrases([(1, b"one two three")], 10)
    texts = [b"one two three four", b"other words", None]
    full, pruned = decontam.search_shard(texts, phrases), decontam.search_shard(texts, phrases, prune=True)
    assert sizes == [6, 3] and full.items == pruned.items == {0: [1]}


def test_pruned_index_answers_the_same(spark):
    rows, items = planted(spark)
    items, df = decontam.collect_items(items), sample_docs(spark).unionByName(rows)
    pruned, full = (collections.Counter(map(str, decontam.find_hits(df, items, prune=p).collect())) for p in (True, False))
    assert pruned == full


def test_spans_and_removal(spark):
    rows, items = planted(spark)
    items = decontam.collect_items(items)
    found = {r.doc_id: r for r in decontam.find_hits(rows, items).collect()}
    text = {r.doc_id: r.text for r in rows.collect()}
    s = found[90_001].spans
    assert len(s) == 1 and text[90_001].encode()[s[0].start:s[0].end].decode().startswith("ONE--TWO") and found[90_001].items == ["1", "6"]
    clean = {r.doc_id: r for r in decontam.remove_hits(rows, items).collect()}
    assert clean[90_001].text == "before  after" and clean[90_001].n_chars == 13
    assert not any(r[-1] for r in brute([(i, r.text) for i, r in clean.items()], [(a, b.decode()) for a, b in items]))


def test_what_a_removal_joins_is_searched_again():
    phrases = decontam.Phrases([(1, b"p q r"), (2, b"s t")], 10)
    assert decontam.clean_texts([b"p s t q r end", None, b""], phrases) == [b" end", None, b""]


def test_edges(spark):
    rows, items = planted(spark)
    assert decontam.find_hits(rows.limit(0), decontam.collect_items(items)).count() == 0
    assert {r.n_hit for r in decontam.find_hits(rows, []).collect()} == {0}
    assert decontam.remove_hits(rows, []).collect() == rows.collect()
    with pytest.raises(ValueError):
        decontam.collect_items(items, max_bytes=10)


def test_index_against_scans():
    r = np.random.default_rng(0)
    for n, sigma, every in ((1, 2, 3), (40, 3, 2), (500, 5, 7), (3000, 200, 32)):
        text = r.integers(0, sigma, n)
        text[-1] = 0
        index = FMIndex(text, sample=every)
        patterns, lengths = r.integers(1, sigma + 1, (60, 4)), r.integers(1, 5, 60)
        low, high = index.search(patterns, lengths)
        for p, m, a, b in zip(patterns, lengths, low, high):
            want = [i for i in range(n - m + 1) if (text[i:i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_suffix_array():
    r = np.random.default_rng(1)
    for _ in range(20):
        x = np.r_[r.integers(1, 4, r.integers(0, 60)), 0]
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_suffix_array_with_long_repeats():
    r = np.random.default_rng(3)
    for n, times in ((200, 5), (30, 40), (1, 500)):
        piece = r.integers(1, 50, n)
        x = np.concatenate([np.r_[piece, 50 + i] if i % 2 else piece for i in range(times)] + [[0]])
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    wide = r.permutation(1 << 31 - 16)[:2000] << 15  # ranks so large that one symbol fills a key's share
    assert suffix_array(wide).tolist() == np.argsort(wide).tolist()


@pytest.mark.parametrize("max_bytes", [1 << 20, 9_000, 2_500])
def test_items_in_parts(spark, max_bytes):
    """A set of items beyond the bound is searched in parts; spans of parts that overlap or touch are one."""
    rows, items = planted(spark)
    items = items.unionByName(spark.read.parquet(f"{SF}/benchmark.parquet").limit(60))
    items = items.unionByName(spark.createDataFrame([(800 + i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(0, 40, 5)], items.schema))
    long = " ".join(f"w{j}" for j in range(60))
    df = sample_docs(spark).unionByName(rows).unionByName(docs(spark, [(90_010, long), (90_010, long)]))
    parts = len(decontam.item_parts(items, max_bytes=max_bytes))
    assert (parts > 1) == (max_bytes < 1 << 20)
    got = decontam.find_benchmark(df, items, max_bytes=max_bytes)
    one = decontam.find_hits(df, decontam.collect_items(items))
    assert got.columns == one.columns and sorted(map(str, got.collect())) == sorted(map(str, one.collect()))
    clean = decontam.remove_benchmark(df.filter("doc_id > 90000"), items, max_bytes=max_bytes)
    assert not any(x[-1] for x in brute([(r.doc_id, r.text) for r in clean.collect()], [tuple(r) for r in items.collect()]))
    assert clean.count() == df.filter("doc_id > 90000").count()
