"""The registered queries ``opN_<name>`` and their DuckDB SQL.

Each query applies its operator to its whole table with production
parameters and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm import (decontam, fingerprints, hard_negatives, line_dedup, mixing, ppm, quality_classifier, quality_rules, sharding, simhash,
                        token_output, url_filter, vector_codes)
from hearth.llm.common import table
from hearth.session import scratch_path

#: Where the public tokenizers lie; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


# The rules of the op3 contract, as (host, path).
URL_ALLOW = [("org", "/"), ("com", "/fr/")]
URL_BLOCK = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op3_url_filter", f"""
WITH rules(rhost, rpath, v) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for v, rs in (('allow', URL_ALLOW), ('block', URL_BLOCK)) for h, p in rs)}),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS rid
  FROM pages),
best AS (
  SELECT rid, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, v := v)) AS b
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict
FROM parts LEFT JOIN best USING (rid)""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_ALLOW, URL_BLOCK)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op7_virtual_slots")
def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_slots(table(spark, sf_dir, "documents"), 16, map_path=scratch_path(spark, "slot-maps"), next_shards=17)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


_SOLID = r"translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"


def _sql_count(chars: str) -> str:
    return f"(length(line) - length(translate(line, '{chars}', '')))"


_ENDED = r"""regexp_matches(line, '[.!?:;…"''»”)\]][\x20\x09-\x0D]*$')"""
_TAIL = r"""regexp_extract(line, '[^.!?:;…"''»”)\]]*$')"""
_LINE_FAILS = f"""(
    {_sql_count(quality_rules.ODD)} * 10 > length({_SOLID})
    OR ({_sql_count("!")} >= 2 AND {_sql_count("!")} * 4 >= length(line) - length({_SOLID}) + 1)
    OR ({_sql_count(_UPPER)} > 8 AND {_sql_count(_UPPER)} > {_sql_count(_LOWER)})
    OR ({_sql_count(quality_rules.BARS)} >= 2 AND {_sql_count(quality_rules.BARS)} * 4 >= length(line) - length({_SOLID}) + 1)
    OR regexp_matches(lower(line), '{"|".join(quality_rules.BOILERPLATE)}')
    OR (NOT {_ENDED} AND length({_TAIL}) - length({_SOLID.replace("line", _TAIL)}) + 1 >= 8))"""


@query("op8_line_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
lines AS (
  SELECT rid, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
short AS (
  SELECT *, has_word AND len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) <= 3 AND NOT {_ENDED} AS short FROM lines),
menu AS (
  SELECT *, count(*) FILTER (short) OVER a = 4 OR count(*) FILTER (short) OVER b = 4 OR count(*) FILTER (short) OVER c = 4 OR count(*) FILTER (short) OVER d = 4 AS in_menu
  FROM short WINDOW a AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),
       c AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), d AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
judged AS (SELECT *, has_word AND (in_menu OR {_LINE_FAILS}) AS bad FROM menu),
per AS (
  SELECT rid, count(*) FILTER (has_word) AS n_lines,
         count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word) AS n_dup_lines,
         count(*) FILTER (bad) AS n_removed_lines,
         coalesce(sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) FILTER (bad), 0) AS lost_words,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS clean
  FROM judged GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, text, len(w) AS n_words,
         length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
         n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_lines, n_removed_lines, lost_words, clean
  FROM d JOIN w USING (rid) JOIN per USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words * 100 <= n_words * {quality_rules.MAX_LOST} AS kept,
       n_lines::BIGINT AS n_lines, n_removed_lines::BIGINT AS n_removed_lines, lost_words::BIGINT AS lost_words,
       CASE WHEN text IS NOT NULL THEN md5(CASE WHEN n_removed_lines = 0 THEN text ELSE clean END) END AS clean_md5
FROM base""")
def op8_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_lines", "n_removed_lines", "lost_words",
                      F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


@query("op4_huffman_tokens")
def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_fm_index_decontamination")
def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


@query("op9_simhash_pivots")
def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Wanted shares of tokens, by the domain that ``labels`` tells.
MIX_WEIGHTS = {"good": 0.975, "low": 0.005, "toxic": 0.02}
MIX_KEEP = "good"


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the rows of ``labels``: toxic, else low or good by quality; else none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


@query("op1_soft_mixing")
def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX_WEIGHTS, MIX_KEEP)
    return out.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(MIX_WEIGHTS)),
                      "rate", "copies", "totals", "targets", "fit")


@query("op2_line_dedup", rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '[^.!?,;:\n]*[.!?,;:\n]|[^.!?,;:\n]+') AS l FROM documents),
pos AS (SELECT rid, doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM d),
cut AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         list_filter(regexp_split_to_array(translate(piece, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM pos),
u AS (
  SELECT rid, doc_id, start, start + length(piece) AS stop, len(w) AS n, array_to_string(w, ' ') AS norm,
         row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS unit
  FROM cut WHERE len(w) > 0),
r AS (
  SELECT *, row_number() OVER o AS place, first_value(doc_id) OVER o AS kd, first_value(start) OVER o AS ks
  FROM u WINDOW o AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, rid, unit)),
g AS (SELECT *, unit - row_number() OVER (PARTITION BY rid ORDER BY unit) AS run FROM r WHERE place > 1)
SELECT doc_id, min(unit)::BIGINT AS unit, count(*)::BIGINT AS n_units, min(start)::BIGINT AS start, max(stop)::BIGINT AS "end",
       sum(n)::BIGINT AS n_words, arg_min(kd, unit) AS kept_doc_id, arg_min(ks, unit)::BIGINT AS kept_start
FROM g GROUP BY rid, doc_id, run HAVING sum(n) >= 30""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents"), unit="clause", min_run=30).drop("row_id")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query("op5_rff_quality")
def op5_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                             held_out=_remainder(4) == 2, calibrate=_remainder(4) == 3)


@query("op10_ppm_scores")
def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"), train=_remainder(7) != 2)


_FINITE = ("embedding IS NOT NULL AND len(embedding) = list_count(embedding)"
           " AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignment and mean of every round, written out; a distance and its entry's index in one number, so the minimum has both."""
    def assigned(book: str) -> str:
        far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        return f"SELECT rid, p, min(coalesce({far}, 0) * {entries} + e) AS best FROM parts JOIN {book} USING (p) GROUP BY rid, p"

    def book(old: str, best: str) -> str:
        return f"""
SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM {old} o LEFT JOIN (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p, e, i, CAST(sum(v) AS DOUBLE) AS s, count(*) AS n
        FROM (SELECT p, best % {entries} AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {best} JOIN parts USING (rid, p)) GROUP BY p, e, i)
  GROUP BY p, e) n ON o.p = n.p AND o.e = n.e"""
    steps = []
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({assigned(f'b{r}')})", f"b{r + 1} AS MATERIALIZED ({book(f'b{r}', f'a{r}')})"]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, {_INTEGERS} AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (
  SELECT rid, vec_id, p::BIGINT AS p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {entries}) USING (rid)),
{', '.join(steps)},
last AS MATERIALIZED ({assigned(f'b{rounds}')}),
rows AS (
  SELECT rid, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM last GROUP BY rid),
text AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM rows JOIN kept USING (rid) CROSS JOIN text"""


@query("op11_trie_codes", _codes_sql())
def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


@query("op12_consistent_sampling")
def op12_consistent_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"), samples=64)


@query("op13_strassen_negatives", f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS MATERIALIZED (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS place FROM scored WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.arid, p.place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON p.arid = n.arid AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5""")
def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)
