"""Substring dedup by digests of lines, paragraphs or clauses.

Texts are cut into units; a unit is normalised (A-Z lower-cased, white space
collapsed) and hashed to 128 bits. Digests are grouped over the whole corpus,
the occurrence of the smallest (key, unit number) is kept and all others are
repeats, told with their original offsets, from which ``remove_units`` cuts them out.

Units are lines, paragraphs (separated by a blank line) or clauses, which end behind one of
``. ! ? , ; :`` or a line feed. Passages that begin or end inside a line are found by clauses.
Every unit that has a word is hashed, however short. ``repeated_units`` tells each repeat; ``repeated_runs`` joins repeats
that follow each other in a text and tells runs of at least ``min_run`` words: copied passages, without the phrases
and single lines that texts share by nature. Those are reached by ``repeated_units(unit="line")``.

Only digests and offsets are shuffled. Digests that occur once are dropped
before the join back; a very frequent unit is one row on one side of that
join, and AQE splits the other side. Runs are formed per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import LOWER, UPPER, Masked, stored

#: Every unit that has a word is looked at; callers may ask for a higher floor.
MIN_WORDS = 1
#: Words in a run of repeated units that is told (of what is reported, not of what is hashed).
MIN_RUN = 30
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
CLAUSE = re.compile(r"[^.!?,;:\n]*[.!?,;:\n]|[^.!?,;:\n]+")
#: Units per output batch.
BATCH = 50_000

_LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def pieces(text: str, unit: str) -> Iterator[tuple[int, str]]:
    """(start, unit) in order; clauses hold their closing mark, lines and paragraphs are without separators."""
    if unit == "clause":
        start = 0
        for piece in CLAUSE.findall(text):
            yield start, piece
            start += len(piece)
        return
    separator, start = SEPARATORS[unit], 0
    for piece in text.split(separator):
        yield start, piece
        start += len(piece) + len(separator)


def units(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(number, start, end, words, digest) of the units with enough words; offsets in characters. Lines and
    paragraphs are numbered all, clauses only if they have a word, so that those about an empty one are neighbours."""
    number = -1
    for start, piece in pieces(text, unit):
        words = piece.encode("utf-8", "surrogatepass").translate(_LOWER_TABLE).split()
        number += bool(words) or unit != "clause"
        if words and len(words) >= min_words:
            yield number, start, start + len(piece), len(words), xxhash.xxh3_128_digest(b" ".join(words))


def unit_table(rows: DataFrame, key: str, text: str, unit: str, min_words: int) -> DataFrame:
    """(key, row_id, unit, start, end, n_words, digest) of the units of ``rows`` (key, row_id, text)."""
    names = ["unit", "start", "end", "n_words", "digest"]
    types = [pa.int64()] * 4 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []

            def out() -> pa.RecordBatch:
                own = batch.select([key, "row_id"]).take(pa.array(at, pa.int64()))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*found), types)]
                return pa.RecordBatch.from_arrays([*own.columns, *columns], [key, "row_id", *names])

            for i, t in enumerate(batch.column(text).to_pylist()):
                for u in units(t or "", unit, min_words):
                    at.append(i)
                    found.append(u)
                if len(found) > BATCH:
                    yield out()
                    at, found = [], []
            if found:
                yield out()

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("row_id", T.LongType())]
                          + [T.StructField(n, T.BinaryType() if n == "digest" else T.LongType()) for n in names])
    return rows.select(key, "row_id", text).mapInArrow(run, schema)


def _repeats(rows: DataFrame, unit: str, min_words: int) -> DataFrame:
    """Units of ``rows`` (_key, row_id, _text) that are not their digest's first, with the kept occurrence."""
    found = stored(unit_table(rows, "_key", "_text", unit, min_words), "units")
    rank = F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("k"), F.col("row_id").alias("r"),
                    F.col("unit").alias("u"), F.col("start").alias("s"))
    first = stored(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
                   .select("digest", "first"), "unit-first")
    mine = F.struct("row_id", "unit")
    return (found.join(first, "digest").filter(mine != F.struct("first.r", "first.u"))
            .select("_key", "row_id", "unit", "start", "end", "n_words", F.col("first.k").alias("kept_key"), F.col("first.s").alias("kept_start")))


def _runs(repeats: DataFrame, min_run: int) -> DataFrame:
    """Repeats of one row whose numbers follow each other, as one; of at least ``min_run`` words."""
    order = Window.partitionBy("row_id").orderBy("unit")
    run = repeats.withColumn("run", F.col("unit") - F.row_number().over(order)).groupBy("_key", "row_id", "run")
    first = F.min(F.struct("unit", "start", "kept_key", "kept_start")).alias("first")
    return (run.agg(first, F.count("*").alias("n_units"), F.max("end").alias("end"), F.sum("n_words").alias("n_words")).filter(F.col("n_words") >= min_run)
            .select("_key", "row_id", "first.unit", "n_units", "first.start", "end", "n_words", "first.kept_key", "first.kept_start"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("row_id"), F.col(text).alias("_text"))


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated unit: key, row_id, unit (number), start, end (characters of the original text),
    n_words, and where the kept occurrence is (kept_<key>, kept_start).

    Occurrences are ranked by key (nulls last), then row, then position, so a unit that a text repeats is
    told from its second occurrence on. Null and empty texts have no units; wholly equal rows are
    ranked as rows; other columns are ignored; an empty table gives an empty table."""
    out = _repeats(_rows(docs, key, text), unit, min_words)
    return out.withColumnsRenamed({"_key": key, "kept_key": f"kept_{key}"})


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "clause", min_run: int = MIN_RUN,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """One row per run of neighbouring repeated units with ``min_run`` words or more: key, row_id, unit (the first one's
    number), n_units, start, end, n_words, and the kept occurrence of the first unit. Everything else as in ``repeated_units``."""
    out = _runs(_repeats(_rows(docs, key, text), unit, min_words), min_run)
    return out.withColumnsRenamed({"_key": key, "kept_key": f"kept_{key}"})


def remove_units(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line",
                 min_words: int = MIN_WORDS, min_run: int = 1) -> DataFrame:
    """``docs`` with the repeated units (in runs of at least ``min_run`` words) cut out of their texts, lines and paragraphs
    with the separator before each (after it at the beginning); removed_spans (original offsets) added, n_chars, where there
    is one, counted anew. Other columns, whatever they are called, stay; one called removed_spans is replaced."""
    own = Masked(docs if text == "removed_spans" else docs.drop("removed_spans"))
    rows = stored(own.df.select("*", F.monotonically_increasing_id().alias("row_id")), "unit-rows")
    plain = rows.select(F.col(own.name[key]).alias("_key"), "row_id", F.col(own.name[text]).alias("_text"))
    gone = _runs(_repeats(plain, unit, min_words), min_run) if min_run > 1 else _repeats(plain, unit, min_words)
    spans = gone.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed_spans"))
    size = len(SEPARATORS.get(unit, ""))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(t: str, a: list, b: list) -> str:
            out, at = [], 0
            for s, e in zip(a, b):
                out.append(t[at:max(s - size, at)])
                at = e
            rest = t[at:]
            return "".join([*out, rest]) if any(out) else rest[size:]
        return pd.Series([t if a is None else one(t, a, b) for t, a, b in zip(texts, starts, ends)])

    out = rows.join(spans, "row_id", "left").withColumn("_new", cut(F.col(own.name[text]), F.col("removed_spans.start"), F.col("removed_spans.end")))
    new = {"removed_spans": F.coalesce("removed_spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")), text: F.col("_new")}
    if "n_chars" in own.columns and text != "n_chars":
        new["n_chars"] = F.when(F.size("removed_spans") > 0, F.length("_new")).otherwise(F.col(own.name["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return own.back(out, new)
