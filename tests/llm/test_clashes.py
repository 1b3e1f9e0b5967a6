"""Extra columns called like any column that an operator uses inside come back as they were."""

import pytest
from pyspark.sql import functions as F

from hearth.llm import decontam, line_dedup, mixing, quality_rules, simhash, url_filter
from tests.llm.util import docs

INSIDE = ["in0", "in1", "in2", "own", "row_id", "_row", "k", "h", "n", "s", "_k", "_h", "_key", "_text", "_hash", "_bytes", "_copy", "_copies", "_new", "_best",
          "_rules_w", "_rules_l", "_rules_h", "_rules_r", "_rules_s", "_rules_bad", "unit", "start", "end", "n_words", "digest", "first", "run", "kept_key",
          "text_hash", "fp", "component", "component_id", "node", "least", "rows", "items", "found", "spans", "removed_spans", "kept", "clean_text", "base_failed",
          "lost_words", "n_lines", "n_removed_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "copies", "rate", "p", "n_tokens",
          "host", "path", "rule", "verdict", "key", "df", "self", "a b", "dot.ted", "back`tick"]
OUT = {"removed_spans", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_removed_lines", "lost_words", "kept",
       "clean_text", "host", "path", "rule", "verdict"}


def crowded(spark):
    long = " ".join(f"word{i}" for i in range(60))
    line = "this very line has more than enough words to count"
    rows = [(1, f"{long}\n{line}"), (2, f"{long}\n{line}"), (3, f"own {line[::-1]} " * 9 + "\none two three four five six seven eight nine ten"), (4, None), (5, "")]
    df = docs(spark, rows).withColumn("url", F.lit("https://a.org/x"))
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in INSIDE])


def mixed(df):
    rows = df.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(1).alias("copies"))
    return mixing.apply_mix(df, rows)


OPERATORS = {
    "keep_one": simhash.keep_one,
    "remove_hits": lambda df: decontam.remove_hits(df, [(1, b"one two three four five six seven eight nine ten")]),
    "remove_units": line_dedup.remove_units,
    "remove_runs": lambda df: line_dedup.remove_units(df, unit="clause", min_run=5),
    "apply_rules": quality_rules.apply_rules,
    "judge": quality_rules.judge,
    "apply_mix": mixed,
    "filter_urls": lambda df: url_filter.filter_urls(df, [("org", "/")], [("com", "/")]),
}
#: Operators whose results have columns of their own, which replace those called alike.
ADDS = {"remove_units", "remove_runs", "judge", "filter_urls"}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    df = crowded(spark)
    out = OPERATORS[name](df)
    assert out.columns[:len(df.columns)] == df.columns or name in ADDS
    rows = [r.asDict() for r in out.collect()]
    assert rows and set(df.columns) <= set(out.columns)
    for r in rows:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in INSIDE if not (name in ADDS and c in OUT)), r


@pytest.mark.parametrize("text", ["in1", "row_id", "k", "_bytes", "kept", "_rules_w", "start", "_copy"])
@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "apply_mix"])
def test_text_column_by_an_inner_name(spark, name, text):
    df = crowded(spark).select("doc_id", "text", "url", "n_chars")
    renamed = df.withColumnRenamed("text", text)
    call = {"keep_one": lambda: simhash.keep_one(renamed, text=text), "remove_hits": lambda: decontam.remove_hits(renamed, [(1, b"one two three four five six seven eight nine ten")], text=text),
            "remove_units": lambda: line_dedup.remove_units(renamed, text=text), "remove_runs": lambda: line_dedup.remove_units(renamed, text=text, unit="clause", min_run=5),
            "apply_rules": lambda: quality_rules.apply_rules(renamed, text=text), "judge": lambda: quality_rules.judge(renamed, text=text),
            "filter_urls": lambda: url_filter.filter_urls(renamed, [("org", "/")], [])}
    got, want = call[name](), OPERATORS[name](df)
    if name in ("judge",) and text == "kept":
        assert [r.kept for r in got.orderBy("doc_id").collect()] == [r.kept for r in want.orderBy("doc_id").collect()]
        return
    assert sorted(map(str, got.withColumnRenamed(text, "text").select(want.columns).collect())) == sorted(map(str, want.collect()))
