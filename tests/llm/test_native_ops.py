"""URL filter, sharding, quality rules against brute force."""

import collections
import re
import zlib

import duckdb
import pytest

from hearth.llm import quality_rules, sharding, url_filter
from hearth.llm.queries import ORACLES, QUERIES, URL_ALLOW, URL_BLOCK
from hearth.session import scratch_path
from tests.llm.util import DOCS, SF, docs, sample_docs, tables_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["op3_url_filter", "op8_line_quality_rules"])
def test_oracle_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert got.columns == rel.columns
    assert rows(got) == collections.Counter(rel.fetchall())


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, rs in (("allow", URL_ALLOW), ("block", URL_BLOCK)) for h, p in rs
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_edges(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.EXAMPLE.ORG/es/x", "http://org", "http://org/", "http://org?x=/",
            "http://example.org/en/1", "http://example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "http://a.com/fr/?q#f",
            "http://a.com/fr", "http://com/de/", "http://a..com/de/x", "http://.org/", "http://x.org:80/", "a://b://c.org/x", "http://É.ORG/\ny"] * 2
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, URL_ALLOW, URL_BLOCK).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), URL_ALLOW, URL_BLOCK).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], []).collect()} == {"allow"}


def test_url_rules_as_tables(spark):
    """Tables of rules judge like lists; keys that the urls cannot match are not encoded."""
    schema = "host string, path string, key string"
    extra = [(f"h{i}.example.net", "/p/", "x") for i in range(3000)]
    allow = spark.createDataFrame([(h, p, "a") for h, p in URL_ALLOW] * 2 + extra, schema)
    block = spark.createDataFrame([(h, p, "b") for h, p in URL_BLOCK] + [(None, "/en/", "n"), ("", "/", "e"), ("net", None, "p")], schema)
    urls = [None, "", "http://org/", "http://org/x", "http://a.example.org/es/1", "http://example.org/en/12", "http://b.com/fr/", "http://b.com/de/",
            "http://h7.example.net/p/q", "http://h7.example.net/r", "http://h3000.example.net/p/", "http://x.net"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, allow, block).collect()}
    listed = url_filter.filter_urls(df, URL_ALLOW + [e[:2] for e in extra], URL_BLOCK + [("net", "")])
    assert got == {r.page_id: (r.rule, r.verdict) for r in listed.collect()}
    assert got[8] == ("h7.example.net/p/", "allow") and got[9] == ("net", "block") and got[0] == (None, "allow")
    mixed = url_filter.filter_urls(df, URL_ALLOW, block.limit(0))
    assert {r.verdict for r in mixed.collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), allow, block).count() == 0
    universe = spark.range(0, 50).selectExpr("concat('k', id) AS key")
    many = spark.range(25, 100_000).selectExpr("concat('k', id) AS key")
    cascade = url_filter.build_cascade(spark, many, universe, 50, max_bits=1000)
    assert universe.filter(cascade.contains(universe.key)).count() == 25


def test_url_shapes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_SHAPES", 4)
    rules = spark.createDataFrame([("org", "/" * i) for i in range(5)], "host string, path string")
    assert len(url_filter.shapes_of(rules.limit(4))) <= 4
    with pytest.raises(ValueError, match="split"):
        url_filter.shapes_of(rules)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = [f"k{i}" for i in range(0, 20_000, 37)] + ["not there"]
    cascade = url_filter.build_cascade(spark, listed, universe, 20_000)
    assert len(cascade.levels) > 2
    got = {r.key for r in universe.filter(cascade.contains(universe.key)).collect()}
    assert got == set(listed) - {"not there"}
    with pytest.raises(ValueError):
        url_filter.build_cascade(spark, listed, universe, 20_000, max_bits=100)


def check_shards(out, df, n_shards):
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    got = out.collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.position)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(n_shards))
    return collections.Counter({h: sum(r.size for r in got if r.shard == h) for h in range(n_shards)})


def test_shards(spark):
    df = sample_docs(spark)
    load = check_shards(sharding.shard_by_slots(df, 4), df, 4)
    assert max(load.values()) - min(load.values()) <= max(len((r.text or "").encode()) + 1 for r in df.collect())
    assert sharding.shard_by_slots(df.limit(0), 4).count() == 0


def test_a_hot_key_is_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 100)
    df = docs(spark, [(7, "hot row")] * 3000 + [(i, f"text {i}") for i in range(6000)])
    load = check_shards(sharding.shard_by_slots(df, 8), df, 8)
    assert max(load.values()) < 1.03 * min(load.values())


def test_map_versions_and_rebalance(spark):
    df = docs(spark, [(i, "x" * (i % 97)) for i in range(5000)])
    rec = sharding.records(df)
    weights, pieces, slot_rows = sharding.slot_weights(rec, 16)
    one = sharding.build_map(weights, pieces, 16)
    path = scratch_path(spark, "maps")
    two = sharding.rebalance(one, weights, 17)
    for m in (one, two):
        m.save(spark, path)
        assert sharding.SlotMap.load(spark, path, m.version) == m
    moved = [k for k in one.shard if one.shard[k] != two.shard[k]]
    total, load = sum(weights.values()), collections.Counter()
    for k, h in two.shard.items():
        load[h] += weights.get(k, 0)
    assert {two.shard[k] for k in moved} == {16} and sum(weights.get(k, 0) for k in moved) < 1.2 * total / 17
    assert max(load.values()) < 1.05 * total / 17
    three = sharding.rebalance(two, weights, 15)
    assert three.version == 3 and set(three.shard.values()) == set(range(15))
    check_shards(sharding.assign(rec, two, slot_rows), df, 17)


def test_query_stores_its_maps(spark, monkeypatch):
    path = scratch_path(spark, "query-maps")
    monkeypatch.setattr("hearth.llm.queries.scratch_path", lambda *_: path)
    got = QUERIES["op7_virtual_slots"](spark, SF).collect()
    one, two = (sharding.SlotMap.load(spark, path, v) for v in (1, 2))
    assert (one.n_shards, two.n_shards, one.pieces) == (16, 17, two.pieces) and got
    for r in got:
        held = {(one.shard[r.virtual_slot, p], two.shard[r.virtual_slot, p]) for p in range(one.pieces[r.virtual_slot])}
        assert (r.shard, r.next_shard) in held
    moved = [r for r in got if r.shard != r.next_shard]
    assert {r.next_shard for r in moved} == {16} and sum(r.size for r in moved) < 1.5 * sum(r.size for r in got) / 17


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    rep = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), failed


def test_quality_counts(spark):
    df = sample_docs(spark).withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    out = quality_rules.judge(df)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == collections.Counter((r.doc_id, *brute_quality(r.text)) for r in df.collect())
    assert all(not r.kept for r in out.collect() if r.base_failed)


def test_line_rules(spark):
    lines = [" ".join(f"plain{i}x{j}" for j in range(20)) + "." for i in range(6)]
    bad = ["All rights reserved.", "Home | About | News | Contact", "BUY THIS NOW AND HERE", "word### word*** word$$$", "wow!! now!! here!!"]
    mixed = "\n".join(lines[:3] + bad + lines[3:] + [""])
    junk = "\n".join([lines[0]] + [" | ".join(["One", "Two", "Three"] + [str(i)] * 9) for i in range(9)])
    out = {r.doc_id: r for r in quality_rules.judge(docs(spark, [(1, "\n".join(lines)), (2, mixed), (3, junk)])).collect()}
    assert out[1].kept and out[1].clean_text == "\n".join(lines) and out[1].n_removed_lines == 0
    assert out[2].kept and out[2].clean_text == "\n".join([*lines, ""]) and out[2].n_removed_lines == 5
    assert not out[3].kept and out[3].n_removed_lines == 9
    kept = quality_rules.apply_rules(docs(spark, [(2, mixed), (3, junk), (4, None)])).collect()
    assert [r.doc_id for r in kept] == [2] and kept[0].n_chars == len(kept[0].text)
    assert quality_rules.apply_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_shouting_in_alternating_case(spark, tmp_path):
    plain = "\n".join(" ".join(f"plain{i}x{j}" for j in range(20)) + "." for i in range(6))
    lines = {1: "AbCdEfGhIjKlMnOpQrS", 2: "A b C d E f G h I j K l M n O p Q", 3: "AbCdEfGhIjKlMnOpQr", 4: "AbCdEfGhIjKlMnO", 5: "AbCdEfGhI\nJkLmNoPqR"}
    df = docs(spark, [(i, f"{plain}\n{x}") for i, x in lines.items()])
    got = {r.doc_id: (r.n_removed_lines, r.clean_text) for r in quality_rules.judge(df).collect()}
    assert got == {i: (1, plain) if i < 3 else (0, f"{plain}\n{x}") for i, x in lines.items()}
    d = tables_dir(tmp_path, spark, documents=df)
    rel = duckdb.connect().sql(ORACLES["op8_line_quality_rules"].replace("FROM documents", f"FROM read_parquet('{d}/documents.parquet/*.parquet')"))
    assert rows(QUERIES["op8_line_quality_rules"](spark, d)) == collections.Counter(rel.fetchall())


def test_line_ends_and_menus(spark, tmp_path):
    body = [" ".join(f"plain{i}x{j}" for j in range(20)) + "." for i in range(12)]
    texts = {
        1: ["A sentence. Then a full line of eight words and", "One sentence of eight words and a mark. Then a few", "seven words are too few for it", 'a full line that ends with a quoted "end"', "eight words and some spaces behind the mark.  \t", "a b c d e f g ?\r", "no mark at all in this line of ten words"],
        2: ["Home", "About us", "Our latest news", "Contact"], 3: ["Home", "About us", "", "News", "Contact"], 4: ["Home", "About us", "News", "a line of five words", "Contact", "More"],
        5: ["Home", "About us.", "News", "Contact", "More"], 6: ["One", "two", "three", "four", "five", "six seven eight nine", "ten"],
        7: ["Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Weiterlesen.", "All people read."]}
    df = docs(spark, [(i, "\n".join(body + x)) for i, x in texts.items()])
    got = {r.doc_id: (r.n_removed_lines, r.clean_text.split("\n")[12:]) for r in quality_rules.judge(df).collect()}
    assert got == {1: (2, texts[1][1:-1]), 2: (4, []), 3: (0, texts[3]), 4: (0, texts[4]), 5: (0, texts[5]), 6: (5, texts[6][5:]), 7: (4, texts[7][4:])}
    d = tables_dir(tmp_path, spark, documents=df.unionByName(sample_docs(spark)))
    rel = duckdb.connect().sql(ORACLES["op8_line_quality_rules"].replace("FROM documents", f"FROM read_parquet('{d}/documents.parquet/*.parquet')"))
    assert rows(QUERIES["op8_line_quality_rules"](spark, d)) == collections.Counter(rel.fetchall())


def test_quality_agrees_with_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.judge(df).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in got}
    assert n.get((1, False, False), 0) == 0  # no good document goes but by the base rules
    assert n.get((0, False, True), 0) <= 0.1 * sum(v for k, v in n.items() if k[0] == 0)


def test_native_plans_have_no_python(spark):
    for name in ("op3_url_filter", "op7_virtual_slots", "op8_line_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_queries_read_awkward_tables(spark, tmp_path):
    d = tables_dir(tmp_path, spark, documents=sample_docs(spark, 20))
    assert QUERIES["op7_virtual_slots"](spark, d).count() == 32
    assert QUERIES["op8_line_quality_rules"](spark, d).count() == 32
