"""Registered queries: market aggregates, valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import market as mk
from hearth.operators import valuation as va
from hearth.operators.util import round_doubles
from hearth.plans.registry import register
from hearth.sources import fixtures as sfx

NUMERIC_SALES = ["price", "bedrooms", "bathrooms", "sqft_living", "sqft_lot", "floors", "waterfront",
                 "view", "condition", "grade", "yr_built", "yr_renovated", "zipcode", "lat", "long",
                 "sqft_above", "sqft_basement", "price_per_sqft", "year", "month"]


def _s(spark, d):
    return sfx.sales(spark, d)


@register("market_kpis", """
SELECT round(avg(price), 4) AS avg_price, round(quantile_cont(price, 0.5), 4) AS median_price,
       max(price) AS max_price, count(*) AS n_properties, round(avg(sqft_living), 4) AS avg_sqft,
       CAST(trunc(avg(sqft_living)) AS BIGINT) AS avg_sqft_int, round(avg(bedrooms), 2) AS avg_bedrooms
FROM sales""")
def q_market_kpis(spark, d):
    return round_doubles(mk.market_kpis(_s(spark, d)), 4, {"avg_bedrooms": 2})


def _describe_sql() -> str:
    parts = []
    for c in NUMERIC_SALES:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
            f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, "
            f"round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM sales")
    return "\nUNION ALL ".join(parts)


@register("describe", _describe_sql())
def q_describe(spark, d):
    return round_doubles(mk.describe(_s(spark, d), NUMERIC_SALES), 4)


def _null_sql() -> str:
    cols = ["id", "date", *NUMERIC_SALES[:17], "price_per_sqft", "year", "month"]
    return "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing "
                               f"FROM raw_sales_clean" for c in cols)


@register("null_counts", "WITH raw_sales_clean AS (SELECT * FROM sales)\n" + _null_sql())
def q_null_counts(spark, d):
    return mk.null_counts(_s(spark, d))


@register("table_profile", """
SELECT count(*) AS n_rows, count(DISTINCT zipcode) AS n_zipcodes, 22 AS n_columns, 21 AS n_numeric,
       'id:bigint date:timestamp_ntz price:double bedrooms:int bathrooms:double sqft_living:bigint sqft_lot:bigint floors:double '
       || 'waterfront:int view:int condition:int grade:int yr_built:int yr_renovated:int zipcode:int lat:double long:double '
       || 'sqft_above:bigint sqft_basement:bigint price_per_sqft:double year:int month:int' AS column_types
FROM sales""")
def q_table_profile(spark, d):
    p = mk.table_profile(_s(spark, d))
    text = F.array_join(F.transform("column_types", lambda c: F.concat(c["column"], F.lit(":"), c["type"])), " ")
    return p.withColumn("column_types", text)


def _corr_sql() -> str:
    parts = []
    for a in NUMERIC_SALES:
        for b in NUMERIC_SALES:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) + 0.0E0 AS r "
                         f"FROM sales")
    return "\nUNION ALL ".join(parts)


@register("correlation_matrix", _corr_sql())
def q_correlation(spark, d):
    return round_doubles(mk.correlation_matrix(_s(spark, d), NUMERIC_SALES), 6)


SUMMARY_SQL = """
SELECT count(*) AS total_properties, round(avg(price), 4) AS avg_price,
       round(quantile_cont(price, 0.5), 4) AS median_price, round(stddev_samp(price), 4) AS price_std,
       round(avg(sqft_living), 4) AS avg_sqft, CAST(sum(bedrooms) AS BIGINT) AS total_bedrooms,
       min(price) AS price_min, max(price) AS price_max
FROM sales"""


CORRELATIONS = "SELECT 'correlation' AS field, col_a, col_b, r AS value FROM (" + _corr_sql() + ")"
SUMMARY_ROWS = f"""
WITH s AS ({SUMMARY_SQL})
SELECT unnest(['total_properties', 'avg_price', 'median_price', 'price_std', 'avg_sqft', 'total_bedrooms', 'price_min', 'price_max']) AS field,
       CAST(NULL AS VARCHAR) AS col_a, CAST(NULL AS VARCHAR) AS col_b,
       unnest([CAST(total_properties AS DOUBLE), avg_price, median_price, price_std, avg_sqft, CAST(total_bedrooms AS DOUBLE), price_min, price_max]) AS value
FROM s
UNION ALL {CORRELATIONS}"""


def _summary_rows(s):
    """A summary record, one row per number, so every nested value is compared."""
    entry = "struct('{0}' AS field, CAST(NULL AS STRING) AS col_a, CAST(NULL AS STRING) AS col_b, round(CAST({1} AS DOUBLE), 4) + 0.0D AS value)"
    plain = [entry.format(c, c) for c in ("total_properties", "avg_price", "median_price", "price_std", "avg_sqft", "total_bedrooms")]
    plain += [entry.format(f"price_{c}", f"price_range.{c}") for c in ("min", "max")]
    corr = ("transform(correlation_matrix, x -> struct('correlation' AS field, x.col_a AS col_a, x.col_b AS col_b, "
            "round(CAST(x.r AS DOUBLE), 6) + 0.0D AS value))")
    return s.selectExpr(f"inline(concat(array({', '.join(plain)}), {corr}))")


@register("summary_stats", SUMMARY_ROWS)
def q_summary_stats(spark, d):
    return _summary_rows(mk.summary_stats(_s(spark, d)))


@register("zipcode_mean_price", """
SELECT zipcode, round(avg(price), 4) AS avg_price FROM sales WHERE zipcode IS NOT NULL
GROUP BY zipcode ORDER BY avg(price) DESC, zipcode LIMIT 10""")
def q_zip_mean(spark, d):
    return round_doubles(mk.zipcode_mean_price(_s(spark, d), 10), 4)


@register("area_kpis", """
SELECT zipcode, count(*) AS n_properties, round(avg(price), 4) AS avg_price,
       round(avg(sqft_living), 4) AS avg_sqft, CAST(trunc(avg(price)) AS BIGINT) AS avg_price_int,
       CAST(trunc(avg(sqft_living)) AS BIGINT) AS avg_sqft_int
FROM sales WHERE zipcode IS NOT NULL GROUP BY zipcode""")
def q_area_kpis(spark, d):
    return round_doubles(mk.area_kpis(_s(spark, d)), 4)


NEIGHBORHOOD_SQL = """
WITH g AS (
  SELECT zipcode, avg(price) AS avg_price, quantile_cont(price, 0.5) AS median_price,
         stddev_samp(price) AS price_std, avg(sqft_living) AS avg_sqft, avg(grade) AS avg_grade,
         avg(price_per_sqft) AS avg_price_per_sqft
  FROM sales WHERE zipcode IS NOT NULL GROUP BY zipcode),
r AS (
  SELECT *, (avg_grade / 10.0E0) * 40.0E0 + (1.0E0 / (price_std / avg_price + 0.001E0)) * 30.0E0
            + (avg_sqft / (SELECT max(avg_sqft) FROM g)) * 30.0E0 AS investment_potential FROM g)
SELECT zipcode, round(avg_price, 4) AS avg_price, round(median_price, 4) AS median_price,
       round(price_std, 4) AS price_std, round(avg_sqft, 4) AS avg_sqft, round(avg_grade, 4) AS avg_grade,
       round(avg_price_per_sqft, 4) AS avg_price_per_sqft, round(investment_potential, 4) AS investment_potential
FROM r"""


@register("neighborhood_ranking", NEIGHBORHOOD_SQL)
def q_neighborhood(spark, d):
    return round_doubles(mk.neighborhood_ranking(_s(spark, d)), 4)


@register("neighborhood_top15", NEIGHBORHOOD_SQL + "\nORDER BY r.investment_potential DESC NULLS LAST, zipcode LIMIT 15")
def q_neighborhood_top(spark, d):
    return round_doubles(mk.rank_neighborhoods(_s(spark, d), 15), 4)


@register("yearly_trend", """
SELECT year, round(avg(price), 4) AS avg_price, round(quantile_cont(price, 0.5), 4) AS median_price,
       count(price) AS sales_volume FROM sales WHERE year IS NOT NULL GROUP BY year""")
def q_yearly(spark, d):
    return round_doubles(mk.yearly_trend(_s(spark, d)), 4)


@register("monthly_seasonality", """
SELECT month, round(avg(price), 4) AS avg_price FROM sales WHERE month IS NOT NULL GROUP BY month""")
def q_monthly(spark, d):
    return round_doubles(mk.monthly_seasonality(_s(spark, d)), 4)


HIST_TAIL = """
c AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((price - lo) * nb / (hi - lo)), nb - 1) END AS INTEGER) AS bin,
             count(*) AS cnt
      FROM sales CROSS JOIN b WHERE price IS NOT NULL GROUP BY 1)
SELECT s.bin, round(lo + s.bin * ((hi - lo) / nb), 4) AS bin_start,
       round(CASE WHEN s.bin = nb - 1 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / nb) END, 4) AS bin_end,
       coalesce(cnt, 0) AS count
FROM b CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(1000)) s LEFT JOIN c ON s.bin = c.bin
WHERE s.bin < nb"""


@register("price_histogram", """
WITH b AS (SELECT CAST(min(price) AS DOUBLE) AS lo, CAST(max(price) AS DOUBLE) AS hi, 50 AS nb FROM sales),
""" + HIST_TAIL)
def q_hist(spark, d):
    return round_doubles(mk.price_histogram(_s(spark, d)), 4)


@register("round_histogram", """
WITH e AS (SELECT min(price) AS lo, max(price) AS hi FROM sales),
w AS (SELECT lo, hi, min(m * pow(10.0E0, k)) AS w FROM e CROSS JOIN (VALUES (2), (5), (10)) t(m)
      CROSS JOIN (SELECT range AS k FROM range(0, 12)) p
      WHERE floor(hi / (m * pow(10.0E0, k))) - floor(lo / (m * pow(10.0E0, k))) + 1 <= 50 GROUP BY lo, hi),
b AS (SELECT CAST(floor(lo / w) AS BIGINT) + range AS at, range AS bin, w FROM w CROSS JOIN range(50)
      WHERE floor(lo / w) + range <= floor(hi / w)),
c AS (SELECT CAST(floor(price / w) AS BIGINT) AS at, count(*) AS cnt FROM sales CROSS JOIN w
      WHERE price IS NOT NULL GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, b.at * w AS bin_start, (b.at + 1) * w AS bin_end, coalesce(cnt, 0) AS count
FROM b LEFT JOIN c ON b.at = c.at""")
def q_round_hist(spark, d):
    return mk.round_histogram(_s(spark, d))


@register("auto_histogram", """
WITH s AS (SELECT min(price) AS lo, max(price) AS hi, count(price) AS n,
                  quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM sales),
w AS (SELECT *, least(greatest(2.0E0 * (q3 - q1) * pow(CAST(n AS DOUBLE), -1.0E0 / 3.0E0),
                               ((hi - lo) / sqrt(CAST(n AS DOUBLE))) / 2.0E0),
                      (hi - lo) / (log2(CAST(n AS DOUBLE)) + 1.0E0)) AS width FROM s),
b AS (SELECT lo, hi, CAST(greatest(CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END, 1)
                         AS INTEGER) AS nb FROM w),
""" + HIST_TAIL)
def q_auto_hist(spark, d):
    return round_doubles(mk.auto_histogram(_s(spark, d)), 4)


@register("price_density", """
WITH s AS (SELECT min(price) AS lo, max(price) AS hi, count(price) AS n, stddev_samp(price) AS sd FROM sales),
p AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2E0) AS bw FROM s),
q AS (SELECT *, lo - 3.0E0 * bw AS g0, hi + 3.0E0 * bw AS g1 FROM p),
k AS (SELECT CAST(g.range AS INTEGER) AS i,
             sum(exp(-0.5E0 * ((q.g0 + g.range * ((q.g1 - q.g0) / 199) - sales.price) / q.bw)
                            * ((q.g0 + g.range * ((q.g1 - q.g0) / 199) - sales.price) / q.bw))) AS ks
      FROM sales CROSS JOIN q CROSS JOIN range(200) g WHERE sales.price IS NOT NULL GROUP BY 1)
SELECT k.i, round(q.g0 + k.i * (q.g1 - q.g0) / 199, 4) AS x,
       round(k.ks / (q.n * q.bw * sqrt(2 * pi())) * 1e6, 6) AS density_per_million
FROM k CROSS JOIN q""")
def q_density(spark, d):
    dens = mk.price_density(_s(spark, d))
    return round_doubles(dens.select("i", "x", (F.col("density") * 1e6).alias("density_per_million")),
                         4, {"density_per_million": 6})


@register("score_distribution", """
SELECT CAST(least(100, CASE WHEN grade >= 8 THEN 30 ELSE 0 END + CASE WHEN waterfront = 1 THEN 30 ELSE 0 END
             + CASE WHEN sqft_living > 3000 THEN 20 ELSE 0 END + CASE WHEN condition >= 4 THEN 20 ELSE 0 END
             + CASE WHEN view >= 3 THEN 15 ELSE 0 END + CASE WHEN yr_renovated > 2000 THEN 10 ELSE 0 END) AS INTEGER)
  AS investment_score, count(*) AS count
FROM sales GROUP BY 1""")
def q_score_dist(spark, d):
    return mk.score_distribution(_s(spark, d))


def _box_sql(by: str | None, value: str = "price") -> str:
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else "CROSS JOIN q"
    where = f"AND {by} IS NOT NULL" if by else ""
    inside = f"{value} >= q1 - 1.5E0 * (q3 - q1) AND {value} <= q3 + 1.5E0 * (q3 - q1)"
    return f"""
WITH q AS (SELECT {keys}quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
                  quantile_cont({value}, 0.75) AS q3
           FROM sales WHERE {value} IS NOT NULL {where} {grp})
SELECT {keys}count(*) AS n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(CASE WHEN {inside} THEN {value} END), 4) AS lower_whisker,
       round(max(CASE WHEN {inside} THEN {value} END), 4) AS upper_whisker,
       CAST(count_if(NOT ({inside})) AS BIGINT) AS n_outliers
FROM (SELECT * FROM sales WHERE {value} IS NOT NULL {where}) t {join}
GROUP BY {keys}q1, median, q3"""


@register("box_stats_bedrooms", _box_sql("bedrooms"))
def q_box_bed(spark, d):
    return round_doubles(mk.box_stats(_s(spark, d), "price", ["bedrooms"]), 4)


@register("box_stats_waterfront", _box_sql("waterfront"))
def q_box_wf(spark, d):
    return round_doubles(mk.box_stats(_s(spark, d), "price", ["waterfront"]), 4)


@register("box_stats", _box_sql(None))
def q_box_all(spark, d):
    return round_doubles(mk.box_stats(_s(spark, d), "price", []), 4)


@register("price_outliers", """
WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM sales)
SELECT id, price FROM sales CROSS JOIN q
WHERE price < q1 - 1.5E0 * (q3 - q1) OR price > q3 + 1.5E0 * (q3 - q1)""")
def q_outliers(spark, d):
    return mk.price_outliers(_s(spark, d)).select("id", "price")


@register("box_stats_ppsf", _box_sql(None, "price_per_sqft"))
def q_box_ppsf(spark, d):
    """Price per sqft has points beyond the fences (zero-size rows)."""
    return round_doubles(mk.box_stats(_s(spark, d), "price_per_sqft", []), 4)


@register("box_stats_ppsf_grade", _box_sql("grade", "price_per_sqft"))
def q_box_ppsf_grade(spark, d):
    return round_doubles(mk.box_stats(_s(spark, d), "price_per_sqft", ["grade"]), 4)


@register("price_outliers_ppsf", """
WITH q AS (SELECT quantile_cont(price_per_sqft, 0.25) AS q1, quantile_cont(price_per_sqft, 0.75) AS q3 FROM sales)
SELECT id, price FROM sales CROSS JOIN q
WHERE price_per_sqft < q1 - 1.5E0 * (q3 - q1) OR price_per_sqft > q3 + 1.5E0 * (q3 - q1)""")
def q_outliers_ppsf(spark, d):
    return mk.price_outliers(_s(spark, d), "price_per_sqft").select("id", "price")


@register("grade_price_bar", """
SELECT grade, count(price) AS n, round(avg(price), 4) AS avg_price,
       round(avg(price) - 1.96E0 * stddev_samp(price) / sqrt(CAST(count(price) AS DOUBLE)), 4) AS ci_low,
       round(avg(price) + 1.96E0 * stddev_samp(price) / sqrt(CAST(count(price) AS DOUBLE)), 4) AS ci_high
FROM sales WHERE grade IS NOT NULL GROUP BY grade""")
def q_grade_bar(spark, d):
    return round_doubles(mk.grade_price_bar(_s(spark, d)), 4)


@register("grade_price_bootstrap", """
WITH r AS (SELECT grade, CAST(id AS VARCHAR) AS k, CAST(price AS DOUBLE) AS y FROM sales WHERE grade IS NOT NULL AND price IS NOT NULL AND id IS NOT NULL),
h AS (SELECT grade, y, b.range AS block, md5(k || '-42-' || CAST(b.range AS VARCHAR)) AS h FROM r CROSS JOIN range(125) b),
p AS (SELECT grade, y, block * 8 + j.range AS replicate, substr(h, 1 + CAST(j.range AS INTEGER) * 4, 4) AS u FROM h CROSS JOIN range(8) j),
w AS (SELECT grade, y, replicate, CASE WHEN u < '5e2d' THEN 0 WHEN u < 'bc5b' THEN 1 WHEN u < 'eb71' THEN 2 WHEN u < 'fb24' THEN 3
                                       WHEN u < 'ff10' THEN 4 WHEN u < 'ffd9' THEN 5 WHEN u < 'fffb' THEN 6 WHEN u < 'ffff' THEN 7 ELSE 8 END AS w FROM p),
m AS (SELECT grade, replicate, sum(w * y) / sum(w) AS mean FROM w GROUP BY grade, replicate HAVING sum(w) > 0),
c AS (SELECT grade, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m GROUP BY grade)
SELECT grade, count(price) AS n, round(avg(price), 4) AS avg_price, round(any_value(ci_low), 3) AS ci_low, round(any_value(ci_high), 3) AS ci_high
FROM sales LEFT JOIN c USING (grade) WHERE grade IS NOT NULL GROUP BY grade""")
def q_grade_bootstrap(spark, d):
    """1,000 replicates in one pass."""
    return round_doubles(mk.grade_price_bootstrap(_s(spark, d)), 3, {"avg_price": 4})


@register("map_centroid", "SELECT round(avg(lat), 6) AS center_lat, round(avg(long), 6) AS center_long FROM sales")
def q_centroid(spark, d):
    return round_doubles(mk.map_centroid(_s(spark, d)), 6)


@register("assistant_context", """
SELECT count(*) AS n_properties, round(avg(price), 4) AS avg_price,
       round(quantile_cont(price, 0.5), 4) AS median_price, count(DISTINCT zipcode) AS n_zipcodes,
       'Dataset: ' || CAST(count(*) AS VARCHAR) || ' properties. Avg price: $' || format('{:,.0f}', avg(price))
       || '. Median: $' || format('{:,.0f}', quantile_cont(price, 0.5)) || '.' || chr(10) || 'Covering '
       || CAST(count(DISTINCT zipcode) AS VARCHAR) || ' zipcodes.' AS context
FROM sales""")
def q_context(spark, d):
    return round_doubles(mk.assistant_context(_s(spark, d)), 4)


VALUATION_SQL = """
WITH m AS (SELECT zipcode, quantile_cont(price_per_sqft, 0.5) AS zm FROM sales
           WHERE zipcode IS NOT NULL GROUP BY zipcode),
v AS (SELECT s.*, s.price_per_sqft / m.zm AS ratio FROM sales s LEFT JOIN m ON s.zipcode = m.zipcode)"""


@register("valuation_ratio", VALUATION_SQL + """
SELECT id, zipcode, round(price_per_sqft, 4) AS price_per_sqft, round(ratio, 6) AS valuation_ratio FROM v""")
def q_valuation(spark, d):
    v = va.valuation_ratio(_s(spark, d)).select("id", "zipcode", "price_per_sqft", "valuation_ratio")
    return round_doubles(v, 4, {"valuation_ratio": 6})


@register("undervalued", VALUATION_SQL + """
SELECT id, price, zipcode, round(price_per_sqft, 4) AS price_per_sqft, sqft_living, bedrooms,
       round(ratio, 6) AS valuation_ratio, grade
FROM v WHERE ratio < 0.8E0 ORDER BY ratio, id LIMIT 10""")
def q_undervalued(spark, d):
    return round_doubles(va.undervalued(_s(spark, d), 10), 4, {"valuation_ratio": 6})


@register("undervalued_all", VALUATION_SQL + """
SELECT id, price, zipcode, round(price_per_sqft, 4) AS price_per_sqft, sqft_living, bedrooms,
       round(ratio, 6) AS valuation_ratio, grade
FROM v WHERE ratio < 0.8E0""")
def q_undervalued_all(spark, d):
    return round_doubles(va.undervalued(_s(spark, d), None), 4, {"valuation_ratio": 6})


@register("area_kpis_one", """
SELECT zipcode, count(*) AS n_properties, round(avg(price), 4) AS avg_price,
       round(avg(sqft_living), 4) AS avg_sqft, CAST(trunc(avg(price)) AS BIGINT) AS avg_price_int,
       CAST(trunc(avg(sqft_living)) AS BIGINT) AS avg_sqft_int
FROM sales WHERE zipcode = 98010 GROUP BY zipcode""")
def q_area_kpis_one(spark, d):
    return round_doubles(mk.area_kpis(_s(spark, d), 98010), 4)
