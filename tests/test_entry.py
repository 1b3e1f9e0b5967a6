"""The driver contract and session settings."""

import re

import __spark_entry__ as entry_mod


def test_entry_runs_flagship(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["id", "price", "zipcode", "price_per_sqft", "sqft_living", "bedrooms",
                          "valuation_ratio", "grade"]
    ratios = [r.valuation_ratio for r in rows]
    assert ratios == sorted(ratios) and all(r < 0.8 for r in ratios)


def test_contract_shapes():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    for name, sql in o.items():
        assert re.match(r"^[a-z][a-z0-9_]*$", name)
        assert "SELECT" in sql.upper()


def test_checkpoint_dir_comes_from_session(spark):
    from hearth.session import ensure_checkpoint_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = ensure_checkpoint_dir(spark)
    if configured:
        assert path == configured
    assert spark.sparkContext.getCheckpointDir() is not None
