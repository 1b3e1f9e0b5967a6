"""Market aggregates: KPIs, profiles, rankings, trends, histograms, boxes.

Every aggregate is a hash aggregate with partial (map-side) aggregation.
Exact medians and quartiles go through ``exact_percentiles`` (sketch-bracketed
selection) so no group is gathered whole; global bounds needed by a later
step stay in the plan as broadcast one-row frames.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.features import investment_score
from hearth.operators.quantiles import exact_percentiles, join_on_keys
from hearth.operators.util import attach, numeric_columns
from hearth.session import materialize


def market_kpis(df: DataFrame, exact: bool = True) -> DataFrame:
    """Average / median / max price, count, average sqft (and its truncated
    display value), average bedrooms (2 dp) in one row."""
    extra = {"avg_price": F.avg("price"), "max_price": F.max("price"),
             "n_properties": F.count(F.lit(1)), "avg_sqft": F.avg("sqft_living"),
             "avg_bedrooms": F.avg("bedrooms")}
    med = exact_percentiles(df, "price", [], [0.5], ["median_price"], exact=exact, extra=extra)
    return med.select(
        "avg_price", "median_price", "max_price", "n_properties", "avg_sqft",
        F.col("avg_sqft").cast("bigint").alias("avg_sqft_int"),
        F.round("avg_bedrooms", 2).alias("avg_bedrooms"))


def describe(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per numeric column, long form.

    The table is unpivoted once to (column, value) so that all columns share
    one aggregate and one percentile selection, grouped by column name.
    """
    cols = cols or numeric_columns(df, exclude=("id",))  # the key is not described
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])))
    extra = {"count": F.count("value"), "mean": F.avg("value"), "std": F.stddev_samp("value"),
             "min": F.min("value"), "max": F.max("value")}
    q = exact_percentiles(long, "value", ["column"], [0.25, 0.5, 0.75],
                          ["p25", "p50", "p75"], exact=exact, extra=extra)
    return q.select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column (one pass, long form)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])))


def table_profile(df: DataFrame) -> DataFrame:
    """Row, zipcode and column counts, and every column's name and type in
    table order."""
    n_num = len(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if "zipcode" in df.columns:
        aggs.append(F.count_distinct("zipcode").alias("n_zipcodes"))
    types = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
                      for f in df.schema.fields])
    return df.agg(*aggs).select("*", F.lit(len(df.columns)).alias("n_columns"),
                                F.lit(n_num).alias("n_numeric"), types.alias("column_types"))


def column_types(df: DataFrame) -> DataFrame:
    """Names and types (from the schema; no job runs)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair, long form (col_a, col_b, r).

    Two passes: column means, then one record per pair and task. A task holds its rows as blocks of a matrix, a
    mask of the present values beside it, and adds up their products (``_pair_sums``); Spark adds up the tasks'
    records, p (p + 1) / 2 each, whatever the number of rows. Sums run over the rows where both
    values are present (R11). The centred form avoids the cancellation of raw
    sums; zero variance gives NULL instead of an ANSI error (R10).
    """
    cols = cols or numeric_columns(df, exclude=("id",))
    spark = df.sparkSession
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    means = [m or 0.0 for m in x.agg(*[F.avg(c) for c in x.columns]).first()]
    s = (x.mapInArrow(lambda batches: _pair_sums(batches, means), PAIR_SUMS)
         .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")],
                                *[f(c).alias(c) for c in ("amin", "amax", "bmin", "bmax") for f in [F.min if c.endswith("min") else F.max]]))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    constant = (n < 2) | (F.col("amax") == F.col("amin")) | (F.col("bmax") == F.col("bmin"))
    r = F.when(constant, F.lit(None).cast("double")).when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(va * vb)))))
    upper = s.filter("n > 0").select("i", "j", r.alias("r"))
    # Mirror the upper triangle; a pair no row covers has no record (r NULL via the spine of all ordered pairs).
    mirrored = upper.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "r"))).otherwise(F.array(
        F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r")))))
    spine = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)], "i int, j int, col_a string, col_b string")
    return spine.join(mirrored, ["i", "j"], "left").select("col_a", "col_b", "r")


PAIR_SUMS = ("i int, j int, n double, sa double, sb double, saa double, sbb double, sab double, "
             "amin double, amax double, bmin double, bmax double")


def _pair_sums(batches: Iterator[pa.RecordBatch], means: list[float]) -> Iterator[pa.RecordBatch]:
    """Masked Gram matrices of a task's rows, about ``means``; extremes of a beside b tell a constant pair."""
    p = len(means)
    n, one, square, cross = (np.zeros((p, p)) for _ in range(4))
    low, high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        there = ~np.isnan(raw)
        mask, x = there.astype(float), np.where(there, raw - means, 0.0)
        n += mask.T @ mask
        one += x.T @ mask           # [a, b]: sum of a where b is present
        square += (x * x).T @ mask
        cross += x.T @ x
        bottom, top = np.where(there, raw, np.inf), np.where(there, raw, -np.inf)
        for b in range(p):
            rows = slice(None) if there[:, b].all() else there[:, b]
            low[:, b] = np.minimum(low[:, b], bottom[rows].min(axis=0, initial=np.inf))
            high[:, b] = np.maximum(high[:, b], top[rows].max(axis=0, initial=-np.inf))
    i, j = np.triu_indices(p)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
        i.astype(np.int32), j.astype(np.int32), n[i, j], one[i, j], one[j, i], square[i, j], square[j, i], cross[i, j],
        low[i, j], high[i, j], low[j, i], high[j, i])], [c.split()[0] for c in PAIR_SUMS.split(", ")])


def summary_stats(df: DataFrame, exact: bool = True, with_time: bool = False) -> DataFrame:
    """One nested record: totals, price statistics, price range and the
    correlation matrix as ``array<struct<col_a, col_b, r>>``."""
    extra = {"total_properties": F.count(F.lit(1)), "avg_price": F.avg("price"),
             "price_std": F.stddev_samp("price"), "avg_sqft": F.avg("sqft_living"),
             "total_bedrooms": F.sum("bedrooms").cast("bigint"),
             "__min": F.min("price"), "__max": F.max("price")}
    med = exact_percentiles(df, "price", [], [0.5], ["median_price"], exact=exact, extra=extra)
    corr = correlation_matrix(df).agg(F.collect_list(F.struct("col_a", "col_b", "r")).alias("correlation_matrix"))
    out = med.crossJoin(corr).select(
        "total_properties", "avg_price", "median_price", "price_std", "avg_sqft", "total_bedrooms",
        F.struct(F.col("__min").alias("min"), F.col("__max").alias("max")).alias("price_range"),
        "correlation_matrix")
    if with_time:
        out = out.withColumn("generated_at", F.current_timestamp())
    return out


def zipcode_mean_price(df: DataFrame, n: int = 10) -> DataFrame:
    """Mean price per zipcode, the n highest (ties by zipcode)."""
    g = (df.filter(F.col("zipcode").isNotNull()).groupBy("zipcode")
           .agg(F.avg("price").alias("avg_price")))
    return g.orderBy(F.desc_nulls_last("avg_price"), "zipcode").limit(n)


def area_kpis(df: DataFrame, zipcode: int | None = None) -> DataFrame:
    """Per zipcode: count, mean price, mean sqft (and truncated displays)."""
    if zipcode is not None:
        df = df.filter(F.col("zipcode") == zipcode)
    g = df.filter(F.col("zipcode").isNotNull()).groupBy("zipcode").agg(
        F.count(F.lit(1)).alias("n_properties"), F.avg("price").alias("avg_price"),
        F.avg("sqft_living").alias("avg_sqft"))
    return g.select("zipcode", "n_properties", "avg_price", "avg_sqft",
                    F.col("avg_price").cast("bigint").alias("avg_price_int"),
                    F.col("avg_sqft").cast("bigint").alias("avg_sqft_int"))


def neighborhood_ranking(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per zipcode statistics and the investment potential

        avg_grade/10*40 + 30/(std/mean + 0.001) + avg_sqft/max(avg_sqft)*30

    The max over zipcodes is a one-row aggregate of the grouped result,
    broadcast back. A one-sale zipcode has NULL std, hence NULL potential,
    ranked last.
    """
    d = df.filter(F.col("zipcode").isNotNull())
    extra = {"avg_price": F.avg("price"), "price_std": F.stddev_samp("price"),
             "avg_sqft": F.avg("sqft_living"), "avg_grade": F.avg("grade"),
             "avg_price_per_sqft": F.avg("price_per_sqft")}
    g = exact_percentiles(d, "price", ["zipcode"], [0.5], ["median_price"], exact=exact, extra=extra)
    mx = g.agg(F.max("avg_sqft").alias("__max_sqft"))
    pot = ((F.col("avg_grade") / 10.0) * 40.0
           + F.try_divide(F.lit(1.0), F.try_divide(F.col("price_std"), F.col("avg_price")) + 0.001) * 30.0
           + F.try_divide(F.col("avg_sqft"), F.col("__max_sqft")) * 30.0)
    return attach(g, mx).select(
        "zipcode", "avg_price", "median_price", "price_std", "avg_sqft", "avg_grade",
        "avg_price_per_sqft", pot.alias("investment_potential"))


def rank_neighborhoods(df: DataFrame, n: int | None = 15) -> DataFrame:
    """Ranking order (potential desc, NULL last, zipcode), first ``n``."""
    r = neighborhood_ranking(df).orderBy(F.desc_nulls_last("investment_potential"), "zipcode")
    return r.limit(n) if n else r


def yearly_trend(df: DataFrame, exact: bool = True) -> DataFrame:
    d = df.filter(F.col("year").isNotNull())
    extra = {"avg_price": F.avg("price"), "sales_volume": F.count("price")}
    g = exact_percentiles(d, "price", ["year"], [0.5], ["median_price"], exact=exact, extra=extra)
    return g.select(
        "year", "avg_price", "median_price", "sales_volume")


def monthly_seasonality(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("month").isNotNull()).groupBy("month")
              .agg(F.avg("price").alias("avg_price")))


def _hist_counts(df: DataFrame, col: str, bounds: DataFrame, bins_col: str) -> DataFrame:
    """Equal-width bins between ``__lo`` and ``__hi`` (last bin closed), with
    a zero-filled spine of all bins built from the one-row bounds."""
    x = F.col(col)
    lo, hi, nb = F.col("__lo"), F.col("__hi"), F.col(bins_col)
    width = (hi - lo) / nb
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide((x - lo) * nb, hi - lo)), nb - 1)).cast("int")
    counts = (attach(df.select(col).filter(x.isNotNull()), bounds)
              .select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spine = bounds.select(F.explode(F.sequence(F.lit(0), (nb - 1).cast("int"))).alias("bin"),
                          "__lo", "__hi", nb.alias("__nb"))
    w = (F.col("__hi") - F.col("__lo")) / F.col("__nb")
    return (spine.join(counts, "bin", "left")
                 .select("bin", (F.col("__lo") + F.col("bin") * w).alias("bin_start"),
                         F.when(F.col("bin") == F.col("__nb") - 1, F.col("__hi"))
                          .otherwise(F.col("__lo") + (F.col("bin") + 1) * w).alias("bin_end"),
                         F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count")))


def price_histogram(df: DataFrame, col: str = "price", bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins from min to max."""
    bounds = df.agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"),
                    F.lit(bins).alias("__bins"))
    return _hist_counts(df, col, bounds, "__bins")


def round_histogram(df: DataFrame, col: str = "price", bins: int = 50) -> DataFrame:
    """At most ``bins`` bins of a round width (2, 5 or 10 times a power of ten) whose edges are multiples of it:
    the smallest such width with which the bins from the least to the greatest value are not too many.

    Bins are half-open and number from 0; empty ones between the two ends are returned with count 0. Nulls and
    NaN are not counted; without any value there are no bins. A constant column has one bin, of width 10 at 0 and else of
    the last power of ten at or below its size. Infinite values fail the query, as no width holds them."""
    if bins < 2:
        raise ValueError("bins must be at least 2: values on both sides of an edge need two")
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    d = df.select(x.alias("__x")).filter("__x IS NOT NULL")
    ends = d.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    size = F.when(span > 0, span / bins).otherwise(F.when(F.col("__hi") != 0, F.abs("__hi")).otherwise(F.lit(10.0)))
    power = F.floor(F.log10(size)).cast("int")
    step = lambda k, m: F.when(k >= 0, m * F.pow(F.lit(10.0), k)).otherwise(m / F.pow(F.lit(10.0), -k))
    # the three powers around the rough size hold a fitting width, whichever way the logarithm was rounded
    widths = F.array(*[step(power + k, F.lit(m)) for k in (-1, 0, 1) for m in (2.0, 5.0, 10.0)])
    number = lambda w: F.floor(F.col("__hi") / w) - F.floor(F.col("__lo") / w) + 1
    fits = F.element_at(F.filter(widths, lambda w: number(w) <= bins), 1)
    finite = F.when(F.abs(span) < F.lit(float("inf")), fits).otherwise(
        F.raise_error(F.lit(f"{col}: no bins hold infinite values")).cast("double"))
    constant = F.when(F.col("__hi") == 0, F.lit(10.0)).otherwise(step(power, F.lit(1.0)))
    bounds = ends.filter("__lo IS NOT NULL").withColumn("__w", F.when(span == 0, constant).otherwise(finite))
    first = F.floor(F.col("__lo") / F.col("__w"))
    counts = (attach(d, bounds).select((F.floor(F.col("__x") / F.col("__w")) - first).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    last = (F.floor(F.col("__hi") / F.col("__w")) - first).cast("int")
    spine = bounds.select(F.explode(F.sequence(F.lit(0), last)).alias("bin"), first.alias("__first"), "__w")
    at = F.col("__first") + F.col("bin")
    return spine.join(counts, "bin", "left").select(
        "bin", (at * F.col("__w")).alias("bin_start"), ((at + 1) * F.col("__w")).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count"))


def auto_histogram(df: DataFrame, col: str = "price", exact: bool = True) -> DataFrame:
    """NumPy's 'auto' rule (NumPy 2): width = min(max(FD, sqrt/2), Sturges)
    with FD = 2 IQR n^-1/3, sqrt = range / sqrt(n), Sturges = range /
    (log2 n + 1); bins = ceil(range / width)."""
    s = exact_percentiles(df, col, [], [0.25, 0.75], ["__q1", "__q3"], exact=exact,
                          extra={"min_": F.min(col).cast("double"), "max_": F.max(col).cast("double")},
                          with_count=True)
    s = s.select(F.col("min_").alias("__lo"), F.col("max_").alias("__hi"), F.col("n").alias("__n"),
                 "__q1", "__q3")
    n = F.col("__n").cast("double")
    rng = F.col("__hi") - F.col("__lo")
    fd = 2.0 * (F.col("__q3") - F.col("__q1")) * F.pow(n, -1.0 / 3.0)
    st = rng / (F.log2(n) + 1.0)
    sq = rng / F.sqrt(n)
    width = F.least(F.greatest(fd, sq / 2.0), st)
    nb = F.when(width > 0, F.ceil(rng / width)).otherwise(F.lit(1)).cast("int")
    bounds = s.select("__lo", "__hi", F.greatest(nb, F.lit(1)).alias("__bins"))
    return _hist_counts(df, col, bounds, "__bins")


#: Cells of the density are so many bandwidths wide, have so many moments, and reach so many bandwidths.
CELL, MOMENTS, REACH = 0.5, 14, 9.5


def _hermite(n: int) -> list[list[int]]:
    """Coefficients, from the constant on, of the first ``n`` Hermite polynomials He: He[k+1] = x He[k] - k He[k-1]."""
    he = [[1], [0, 1]]
    while len(he) < n:
        k = len(he) - 1
        a, b = [0, *he[k]], [*he[k - 1], 0, 0]
        he.append([x - k * y for x, y in zip(a, b)])
    return he[:n]


def price_density(df: DataFrame, col: str = "price", gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (n^-1/5 times the sample std),
    evaluated on ``gridsize`` points from min - cut*bw to max + cut*bw, by a fast Gauss transform.

    In bandwidths, with c the centre of a value's cell and z = value - c:
    exp(-(t - c - z)^2 / 2) = exp(-(t - c)^2 / 2) * sum over k of He_k(t - c) z^k / k!.
    So a row adds to MOMENTS powers of its cell (one grouped aggregate; its cost does not
    depend on the grid), and grid points sum the cells within REACH. With |z| <= CELL / 2 what is left out is, by
    |He_k(x)| exp(-x^2 / 4) <= 1.09 sqrt(k!), below 1.09 sum over k >= MOMENTS of (CELL / 2)^k / sqrt(k!) < 2e-14 of a
    value's kernel height, and exp(-REACH^2 / 2) < 3e-20 beyond the reach."""
    s = df.agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"),
               F.count(col).alias("__n"), F.stddev_samp(col).alias("__sd"))
    bw = F.col("__sd") * F.pow(F.col("__n").cast("double"), -0.2)
    s = s.select("*", bw.alias("__bw"))
    s = s.select("*", (F.col("__lo") - cut * F.col("__bw")).alias("__g0"),
                 (F.col("__hi") + cut * F.col("__bw")).alias("__g1"))
    s = s.withColumn("__d", F.try_divide(F.col("__g1") - F.col("__g0"), F.lit(gridsize - 1) * F.col("__bw")))
    x = df.select(F.col(col).cast("double").alias("__x")).filter("__x IS NOT NULL")
    # In units of the bandwidth, from the first grid point on.
    u = attach(x, s.select("__g0", "__bw")).select(F.try_divide(F.col("__x") - F.col("__g0"), F.col("__bw")).alias("__u")).filter("__u IS NOT NULL")
    u = u.select(F.floor(F.col("__u") / CELL).alias("__cell"), "__u")
    z = F.col("__u") - (F.col("__cell") + 0.5) * CELL
    power, moments = F.lit(1.0), []
    for k in range(MOMENTS):
        moments.append((F.sum(power) / math.factorial(k)).alias(f"__m{k}"))
        power = power * z
    cells = u.groupBy("__cell").agg(*moments)
    he = _hermite(MOMENTS)
    coefficient = [sum((F.col(f"__m{k}") * float(he[k][j]) for k in range(j, MOMENTS) if he[k][j]), F.lit(0.0)) for j in range(MOMENTS)]
    cells = attach(cells.select(((F.col("__cell") + 0.5) * CELL).alias("__c"), *[c.alias(f"__p{j}") for j, c in enumerate(coefficient)]), s.select("__d"))
    first = F.greatest(F.ceil((F.col("__c") - REACH) / F.col("__d")), F.lit(0))
    last = F.least(F.floor((F.col("__c") + REACH) / F.col("__d")), F.lit(gridsize - 1))
    near = cells.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("__t", F.col("i") * F.col("__d") - F.col("__c"))
    value = F.lit(0.0)
    for j in reversed(range(MOMENTS)):
        value = value * F.col("__t") + F.col(f"__p{j}")
    sums = near.groupBy("i").agg(F.sum(value * F.exp(F.col("__t") * F.col("__t") * -0.5)).alias("__k"))
    grid = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("i"))
    scale = F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi)
    return grid.join(sums, "i", "left").select(
        "i", (F.col("__g0") + F.col("i") * ((F.col("__g1") - F.col("__g0")) / (gridsize - 1))).alias("x"),
        F.try_divide(F.when(F.col("__d").isNotNull(), F.coalesce("__k", F.lit(0.0))), scale).alias("density"))


def score_distribution(df: DataFrame) -> DataFrame:
    s = investment_score(df.columns)
    return df.select(s.alias("investment_score")).groupBy("investment_score").agg(
        F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, value: str = "price", by: list[str] | tuple = (),
              exact: bool = True) -> DataFrame:
    """Per group: q1, median, q3, whiskers at 1.5 IQR (the most extreme data
    inside the fences) and the number of points outside. Quartiles by
    selection; the fences go back to the rows by a join on the group key:
    the planner broadcasts them if their stored size allows, else AQE
    splits a hot key."""
    by = list(by)
    d = df.filter(F.col(value).isNotNull())
    for b in by:
        d = d.filter(F.col(b).isNotNull())
    q = exact_percentiles(d, value, by, [0.25, 0.5, 0.75], ["q1", "median", "q3"], exact=exact)
    iqr = F.col("q3") - F.col("q1")
    f = q.select(*by, "q1", "median", "q3", (F.col("q1") - 1.5 * iqr).alias("__lf"),
                 (F.col("q3") + 1.5 * iqr).alias("__uf"))
    if by:
        f = materialize(f, "fences")
    j = join_on_keys(d.select(*dict.fromkeys([*by, value])), f, by)
    v = F.col(value)
    inside = (v >= F.col("__lf")) & (v <= F.col("__uf"))
    agg = j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("lower_whisker"),
        F.max(F.when(inside, v)).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg.select(*by, "n", "q1", "median", "q3", "lower_whisker", "upper_whisker", "n_outliers")


def price_outliers(df: DataFrame, value: str = "price", exact: bool = True) -> DataFrame:
    """Rows beyond the 1.5 IQR fences of the whole table."""
    q = exact_percentiles(df, value, [], [0.25, 0.75], ["__q1", "__q3"], exact=exact)
    iqr = F.col("__q3") - F.col("__q1")
    j = attach(df, q)
    v = F.col(value)
    out = j.filter((v < F.col("__q1") - 1.5 * iqr) | (v > F.col("__q3") + 1.5 * iqr))
    return out.drop("__q1", "__q3")


def grade_price_bar(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Mean price per grade with a normal-approximation 95 % interval; ``grade_price_bootstrap``
    resamples, as the reference's chart does."""
    g = df.filter(F.col("grade").isNotNull()).groupBy("grade").agg(
        F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("__sd"),
        F.count("price").alias("n"))
    half = z * F.col("__sd") / F.sqrt(F.col("n").cast("double"))
    return g.select("grade", "n", "avg_price", (F.col("avg_price") - half).alias("ci_low"),
                    (F.col("avg_price") + half).alias("ci_high"))


#: Replicates whose weights come out of one hash of 32 hexadecimal digits, by the bits that each weight takes.
PER_HASH, WEIGHT_BITS = 8, 16


def poisson_steps(bits: int = WEIGHT_BITS) -> list[int]:
    """Numbers of ``bits`` bits from which on a Poisson(1) weight is at least 1, 2, ...: its distribution function."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        at = round(total * 2 ** bits)
        if at >= 2 ** bits:
            return steps
        steps.append(at)
        k += 1


#: MD5's shifts and constants.
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_words(keys: np.ndarray, suffix: bytes) -> list[np.ndarray]:
    """The four little-endian words of MD5 of each key followed by ``suffix``, for many keys at once. ``keys``: bytes (n, length)."""
    n, length = keys.shape
    size = length + len(suffix)
    if size > 55:  # more than one block of MD5
        out = np.frombuffer(b"".join(hashlib.md5(k.tobytes() + suffix).digest() for k in keys), "<u4").reshape(n, 4)
        return [out[:, i].copy() for i in range(4)]
    own = -(-length // 4)
    wide = np.zeros((n, 4 * own), np.uint8)
    wide[:, :length] = keys
    last = np.frombuffer((bytes(length) + suffix + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    words = [w | x for w, x in zip(np.ascontiguousarray(wide.view("<u4").T), last)] + list(last[own:])
    a, b, c, d = (np.full(n, x) for x in _START)
    f, up = np.empty(n, np.uint32), np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(64):
            # In place: a step's numbers stay in the processor's nearest memory.
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(a, f, out=a)
            if g < own:
                np.add(a, words[g], out=a)
                np.add(a, _SINES[i], out=a)
            else:
                np.add(a, words[g] + _SINES[i], out=a)
            turn = np.uint32(_TURNS[i // 16][i % 4])
            np.left_shift(a, turn, out=up)
            np.right_shift(a, np.uint32(32) - turn, out=a)
            np.bitwise_or(a, up, out=a)
            np.add(a, b, out=a)
            a, d, c, b = d, c, b, a
        return [x + y for x, y in zip((a, b, c, d), _START)]


#: Rows hashed at a time, and groups whose sums a task holds at most.
HASHED, HELD_GROUPS = 16_384, 1000


def bootstrap_sums(df: DataFrame, by: str, value: str, replicates: int = 1000, seed: int = 42, key: str = "id") -> DataFrame:
    """(by, replicate, weight, total) of a Poisson bootstrap: in replicate b a row counts Poisson(1) times, by a hash of its key, the
    seed and b. All replicates are summed in one pass and do not depend on partitioning; a task sends on one row per group and replicate.
    Rows without group, key or value are left out."""
    rows = df.filter(F.col(by).isNotNull() & F.col(key).isNotNull() & F.col(value).isNotNull()).select(
        F.col(by).alias("__by"), F.col(key).cast("string").alias("__key"), F.col(value).cast("double").alias("__y"))
    # A row is worked on once per replicate, so rows are dealt to all cores however few bytes they have.
    rows = rows.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    kind = rows.schema["__by"].dataType.simpleString()
    blocks = -(-replicates // PER_HASH)
    # The weight by a hash's 16 bits as they lie in a little-endian word.
    u = np.arange(2 ** WEIGHT_BITS, dtype="<u2")
    weight_of = np.searchsorted(poisson_steps(), u.byteswap(), side="right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, (w, s) in held.items():
                names = pa.array([name], kind_of).take(pa.array(np.zeros(replicates, int)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(replicates, dtype=np.int32)), pa.array(w[:replicates].astype(np.int64)), pa.array(s[:replicates])],
                                                 ["__by", "replicate", "weight", "total"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            kind_of = batch.column("__by").type
            groups = batch.column("__by").dictionary_encode()
            names, code, y = groups.dictionary.to_pylist(), groups.indices.to_numpy(), batch.column("__y").to_numpy()
            keys = [k.encode() for k in batch.column("__key").to_pylist()]
            length = np.array([len(k) for k in keys])
            order = np.lexsort((code, length))
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                for at in range(0, len(part), HASHED):
                    i = part[at:at + HASHED]
                    text = np.frombuffer(b"".join([keys[j] for j in i]), np.uint8).reshape(len(i), length[i[0]])
                    start, own = np.flatnonzero(np.r_[True, np.diff(code[i]) != 0]), y[i]
                    sums = np.empty((2, len(start), blocks * PER_HASH))
                    for block in range(blocks):
                        for word, x in enumerate(md5_words(text, f"-{seed}-{block}".encode())):
                            for half, bits in enumerate((x & np.uint32(0xFFFF), x >> np.uint32(WEIGHT_BITS))):
                                w, to = weight_of[bits], block * PER_HASH + 2 * word + half
                                sums[0, :, to] = np.add.reduceat(w, start)
                                sums[1, :, to] = np.add.reduceat(w * own, start)
                    for g, c in enumerate(code[i[start]]):
                        if names[c] in held:
                            held[names[c]] += sums[:, g]
                        else:
                            held[names[c]] = sums[:, g].copy()
                    if len(held) > HELD_GROUPS:
                        yield from told()
        if held:
            yield from told()

    drawn = rows.mapInArrow(run, f"__by {kind}, replicate int, weight bigint, total double")
    return drawn.groupBy(F.col("__by").alias(by), "replicate").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def grade_price_bootstrap(df: DataFrame, by: str = "grade", value: str = "price", replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean per group with a bootstrap percentile interval of the mean (linear interpolation between replicates). A
    replicate that drew no row of a group is left out of that group's interval."""
    sums = bootstrap_sums(df, by, value, replicates, seed).filter("weight > 0")
    mean = F.col("total") / F.col("weight")
    tail = (1 - level) / 2
    # A group has one mean per replicate.
    ci = sums.groupBy(by).agg(F.percentile(mean, tail).alias("ci_low"), F.percentile(mean, 1 - tail).alias("ci_high"))
    plain = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("avg_price"))
    return plain.join(ci, by, "left").select(by, "n", "avg_price", "ci_low", "ci_high")


def map_centroid(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("lat").alias("center_lat"), F.avg("long").alias("center_long"))


def assistant_context(df: DataFrame, exact: bool = True) -> DataFrame:
    """Inputs of the assistant's context sentence and the sentence itself
    (fixed value: the wording is the operator's output)."""
    extra = {"n_properties": F.count(F.lit(1)), "avg_price": F.avg("price"),
             "n_zipcodes": F.count_distinct("zipcode")}
    j = exact_percentiles(df, "price", [], [0.5], ["median_price"], exact=exact, extra=extra)
    text = F.concat(F.lit("Dataset: "), F.col("n_properties").cast("string"),
                    F.lit(" properties. Avg price: $"), F.format_number(F.col("avg_price"), 0),
                    F.lit(". Median: $"), F.format_number(F.col("median_price"), 0),
                    F.lit(".\nCovering "), F.col("n_zipcodes").cast("string"), F.lit(" zipcodes."))
    return j.select("n_properties", "avg_price", "median_price", "n_zipcodes", text.alias("context"))
