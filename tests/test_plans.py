"""Physical-plan checks: top-n, per-group limits, pushdown, no Python."""

import contextlib
import io

import pytest

from tests.conftest import SF_SMALL
from hearth.plans.registry import ORACLES, QUERIES, load_all

load_all()


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["top_price", "undervalued", "sample_n", "recommend", "cheapest_per_sqft"])
def test_top_n_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("name", ["recent_notifications", "recent_chat"])
def test_per_group_limit_before_shuffle(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_filter_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from hearth.sources.tables import read_table
    df = read_table(spark, SF_SMALL, "orders").filter(F.col("o_totalprice") > 1000).select("o_orderkey")
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_sales_scan_prunes_columns(spark):
    p = plan_of(QUERIES["top_price"](spark, SF_SMALL))
    assert "o_orderstatus" not in p and "o_orderpriority" not in p and "c_name" not in p


# These fit tree models at full settings when built.
# Built by fitting trees, whose models are scored in Arrow batches.
TREES = {"fit_forest", "fit_boosted_a", "fit_boosted_b", "compare_models", "predict", "feature_importance",
        "cross_validate", "shapley_attribution", "shapley_row"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_no_python_in_plans(spark, name):
    if name in TREES or name in ("scan_csv", "land_upload", "export_csv", "snapshot_cache", "append_listing",
                "event_type_counts_stream"):
        pytest.skip("writes files or fits trees when built")
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_exact_median_is_not_a_group_gather(spark):
    """The grouped median goes through the sketch aggregate (checkpointed
    bracket table), never Spark's whole-group ``percentile``/``median``."""
    p = plan_of(QUERIES["neighborhood_ranking"](spark, SF_SMALL))
    assert "median(" not in p and "percentile(" not in p
    from pyspark.sql import functions as F
    from hearth.operators.quantiles import exact_percentiles
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    p = plan_of(exact_percentiles(df, "v", ["g"], [0.5], max_bracket=None))
    assert "percentile_approx" in p and "percentile(" not in p


def test_density_fans_no_row_out(spark):
    """Generated rows are those of the grid, and the grid points near a cell: both above an aggregate, never above a scan."""
    p = plan_of(QUERIES["price_density"](spark, SF_SMALL))
    parts = p[:p.index("\n\n\n")].split("Generate")
    assert len(parts) == 3
    for below in parts[1:]:
        assert 0 <= below.find("HashAggregate") < (below.find("Scan parquet") if "Scan parquet" in below else len(below))


def test_correlation_fans_no_row_out(spark):
    """Products are added up per task; only the mirrored pairs are generated, above the aggregate."""
    p = plan_of(QUERIES["correlation_matrix"](spark, SF_SMALL))
    tree = p[:p.index("\n\n\n")]
    assert tree.count("Generate") == 1 and tree.index("Generate") < tree.index("HashAggregate")


def test_percentiles_meet_one_row_per_group(spark):
    """Values are joined with one bracket row; only counted values are set against single percentiles."""
    from pyspark.sql import functions as F
    from hearth.operators.quantiles import exact_percentiles
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    p = plan_of(exact_percentiles(df, "v", ["g"], [0.25, 0.5, 0.75]))
    tree = p[:p.index("\n\n\n")]
    assert tree.count("Generate") == 1


def test_event_counts_scan_once(spark):
    p = plan_of(QUERIES["event_type_counts"](spark, SF_SMALL))
    assert p[:p.index("\n\n\n")].count("Scan parquet") == 1
