"""Repeated units against brute force and SQL."""

import collections

import duckdb
import pytest

from hearth.llm import line_dedup
from hearth.llm.queries import ORACLES, QUERIES
from tests.llm.util import SF, docs, sample_docs


def norm(unit):
    return tuple("".join(c.lower() if c.isascii() else c for c in unit).replace("\x1c", "?").split(" ")) if unit else ()


def key_of(unit):
    import re
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in unit)))


def brute(rows, separator="\n", min_words=8):
    """Rows in rank order; spans to remove of each."""
    first, out = {}, []
    for n, (i, t) in enumerate(rows):
        start = 0
        for u, unit in enumerate((t or "").split(separator)):
            k = key_of(unit)
            if len(k) >= min_words:
                if k in first:
                    out.append((i, u, start, start + len(unit), len(k), *first[k]))
                else:
                    first[k] = (i, start)
            start += len(unit) + len(separator)
    return collections.Counter(out)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = QUERIES["op2_line_dedup"](spark, SF)
    rel = con.sql(ORACLES["op2_line_dedup"])
    assert got.columns == rel.columns
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(rel.fetchall())


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_against_brute_force(spark, unit):
    extra = [(20_000 + i, "\n\n".join(["one TWO three four five  six seven", f"own words of {i} and so on here", "ünï cödé words are words too yes"] * (1 + i % 2))) for i in range(40)]
    df = sample_docs(spark).filter("doc_id IS NOT NULL AND doc_id != 10004").unionByName(docs(spark, extra)).repartition(4)
    got = line_dedup.repeated_units(df, unit=unit, min_words=6).drop("row_id")
    want = brute(sorted((r.doc_id, r.text) for r in df.collect()), line_dedup.SEPARATORS[unit], 6) if unit else None
    assert collections.Counter(map(tuple, got.collect())) == want and sum(want.values()) > 50


def test_removal_keeps_offsets(spark):
    line = "this very line has more than enough words to count"
    rows = [(1, f"head\n{line}\ntail"), (2, f"{line.upper()}\nrest of two"), (3, f"start\n{line}"), (4, line), (4, line), (5, None), (6, ""), (7, f"a\n{line}\nb\n{line}\nc")]
    out = line_dedup.remove_units(docs(spark, rows).withColumnRenamed("lang", "row_id_").withColumnRenamed("source", "digest"))
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert got == collections.Counter([(1, f"head\n{line}\ntail", 10 + len(line)), (2, "rest of two", 11), (3, "start", 5), (4, "", 0), (4, "", 0),
                                       (5, None, None), (6, "", 0), (7, "a\nb\nc", 5)])
    spans = {r.doc_id: r.removed_spans for r in out.collect()}
    assert [(s.start, s.end) for s in spans[7]] == [(2, 2 + len(line)), (5 + len(line), 5 + 2 * len(line))] and spans[1] == []


def test_wholly_equal_rows_and_edges(spark):
    line = "this very line has more than enough words to count"
    got = line_dedup.repeated_units(docs(spark, [(4, line)] * 5 + [(None, line)] * 2)).collect()
    assert len(got) == 6 and {r.kept_doc_id for r in got} == {4}
    assert line_dedup.repeated_units(docs(spark, [])).count() == 0
    assert line_dedup.remove_units(docs(spark, [])).count() == 0


def clauses(text):
    """(start, clause): cut behind every mark, by hand."""
    start = at = 0
    for at, c in enumerate(text):
        if c in ".!?,;:\n":
            yield start, text[start:at + 1]
            start = at + 1
    if start < len(text):
        yield start, text[start:]


def brute_runs(rows, min_run):
    first, out = {}, collections.Counter()
    for i, t in rows:
        run, number = [], -1
        for start, c in [*clauses(t or ""), (0, "")]:
            k = key_of(c)
            number += bool(k)
            if k in first:
                run.append((number, start, start + len(c), len(k), *first[k]))
                continue
            if not k and c:
                continue
            if k:
                first[k] = (i, start)
            if sum(r[3] for r in run) >= min_run:
                out[(i, run[0][0], len(run), run[0][1], run[-1][2], sum(r[3] for r in run), *run[0][4:])] += 1
            run = []
    return out


@pytest.mark.parametrize("min_run", [1, 8, 30])
def test_runs_against_brute_force(spark, min_run):
    passage = "Of all that is said here, some comes again: word for word; and whole.\n\n . \nIt begins anywhere, and ends"
    extra = [(30_000 + i, f"own start {i} {passage} somewhere {i}. Yes, no: " + passage.upper() * (i % 3)) for i in range(30)]
    df = sample_docs(spark).filter("doc_id IS NOT NULL AND doc_id != 10004").unionByName(docs(spark, extra)).repartition(4)
    got = line_dedup.repeated_runs(df, min_run=min_run).drop("row_id")
    want = brute_runs(sorted((r.doc_id, r.text) for r in df.collect()), min_run)
    assert collections.Counter(map(tuple, got.collect())) == want and sum(want.values()) > 25


def test_query_tells_runs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_runs(sorted((r.doc_id, r.text) for r in rows), 30)
    assert want and collections.Counter(map(tuple, QUERIES["op2_line_dedup"](spark, SF).collect())) == want


def test_single_repeated_lines_are_reached(spark):
    """Licence lines and the like are not runs; they are told by lines."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(sorted((r.doc_id, r.text) for r in rows), min_words=1)
    assert sum(n for r, n in want.items() if r[4] < 8) > 0
    got = line_dedup.repeated_units(spark.read.parquet(f"{SF}/documents.parquet")).drop("row_id")
    assert collections.Counter(map(tuple, got.collect())) == want


def test_removal_of_runs(spark):
    same = "a passage of some words, that two texts hold: in full."
    rows = [(1, f"First. {same} End."), (2, f"Second! {same.upper()} Other end, in full."), (3, None), (4, "")]
    out = line_dedup.remove_units(docs(spark, rows), unit="clause", min_run=10)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: (rows[0][1], len(rows[0][1])), 2: ("Second! Other end, in full.", 27), 3: (None, None), 4: ("", 0)}


def test_long_text_is_one_row(spark):
    text = "word " * 30 + "\n" + "one, " * 200_000
    got = line_dedup.repeated_runs(docs(spark, [(1, text), (2, "one," * 40)])).collect()
    assert [(r.doc_id, r.n_units, r.n_words) for r in sorted(got)] == [(1, 199_999, 199_999), (2, 40, 40)]


def test_short_units(spark):
    rows = [(1, "All rights reserved.\n\nHead"), (2, "one\nall  RIGHTS reserved.\nhead\n \n"), (3, "\n \nOne")]
    got = sorted(tuple(r) for r in line_dedup.repeated_units(docs(spark, rows)).drop("row_id").collect())
    assert got == [(2, 1, 4, 25, 3, 1, 0), (2, 2, 26, 30, 1, 1, 22), (3, 2, 3, 6, 1, 2, 0)]
    assert line_dedup.repeated_units(docs(spark, rows), min_words=4).count() == 0
    assert {r.doc_id: r.text for r in line_dedup.remove_units(docs(spark, rows)).collect()} == {
        1: rows[0][1], 2: "one\n \n", 3: "\n "}
