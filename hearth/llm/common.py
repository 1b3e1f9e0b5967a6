"""Helpers shared by the operators: table reading, stored intermediate
tables, literal tables and literal arrays.

Intermediate results that are read more than once are written as Parquet
under the cluster's shared checkpoint folder and read back (``stored``): the
lineage is cut, a lost executor costs one re-read, and row ids taken before
the write stay what they were.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}
#: The white space that separates words in the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small table as one JSON literal (JVM only: no pickled rows)."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{_colons(schema)}>>")))


def _colons(schema: str) -> str:
    return ",".join(":".join(p.split(None, 1)) for p in schema.split(","))


def literal_array(values: Iterable[int]) -> Column:
    """``array<bigint>`` literal; one string literal that Catalyst folds, so a
    large array does not become one expression per element."""
    text = ",".join(map(str, values))
    if not text:
        return F.expr("cast(array() as array<bigint>)")
    return F.split(F.lit(text), ",").cast("array<bigint>")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


class Masked:
    """A table under column names that no operator uses inside, and the way back.

    ``df`` has the columns ``in0``, ``in1``, ... ; ``name[c]`` is the one of input column ``c``. So an input
    column may be called like any column that an operator adds on its way."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.name = {c: f"in{i}" for i, c in enumerate(docs.columns)}
        self.df = docs.toDF(*self.name.values())

    def back(self, df: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
        """The input's columns under their own names and the ``new`` ones, which replace those called alike."""
        new = dict(new or {})
        kept = [new.pop(c, F.col(n)).alias(c) for c, n in self.name.items()]
        return df.select(*kept, *[c.alias(n) for n, c in new.items()])
