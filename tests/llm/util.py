"""Fixtures shared by the operator tests."""

import os
import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """rows: (doc_id, text); other columns are filled."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def sample_docs(spark, n=150):
    """Real rows of the smallest table plus the awkward ones."""
    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n)
    long = " ".join(random.Random(1).choice(["and", "the", "of", "Sun", "moon.", "\n"]) for _ in range(30_000))
    odd = [(10_001, None), (10_002, ""), (10_003, " \n\t "), (10_004, long), (10_004, long), (None, "a null id here"),
           (10_005, "word"), (10_006, "\u00e9\U0001f600 caf\u00e9 \x00\x0b x"), (10_007, "same"), (10_008, "same"),
           (10_009, "a  b <|endoftext|> c \n\n  d\u00a0e "), (10_010, "don't won't I'm 12345 !!!??\r\n\r\nx")]
    return real.unionByName(docs(spark, odd))


def tables_dir(tmp_path, spark, **tables):
    """A folder of tables as the queries read them; those not given come from the smallest size."""
    d = tmp_path / "tables"
    d.mkdir()
    for name in ("documents", "pages", "labels", "benchmark"):
        if name in tables:
            tables[name].write.parquet(f"{d}/{name}.parquet")
        else:
            os.symlink(f"{SF}/{name}.parquet", d / f"{name}.parquet")
    return str(d)
