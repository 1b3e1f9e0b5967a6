"""Exact grouped percentiles without gathering a group into one task.

Spark's exact ``percentile``/``median`` keeps a value->count map per group and
merges the whole map of a group in one task, so a group that holds a third of
the rows becomes a third of the data in one task. Here the exact answer is
found by selection instead:

1. one aggregate builds a ``percentile_approx`` sketch per group (bounded in
   size, merged partially on every partition);
2. from the sketch, a bracket ``[lo, hi]`` around each target rank is chosen
   with a margin of four times the sketch's rank error, so the exact value is
   inside it;
3. a second pass sets each value against its group's brackets (one row per
   group) and counts the values below, inside and above: per distinct value
   inside a bracket (at most about ``10 n / accuracy`` values, whatever the
   skew), and as one number outside;
4. a running sum over those few values finds the exact order statistics,
   interpolated linearly (pandas' default, DuckDB ``quantile_cont``).

If the sketch ever broke its bound the bracket check fails the query loudly
(``raise_error``) instead of returning a wrong value. Groups smaller than the
sketch accuracy skip the bracket and are ranked whole (bounded by
``accuracy`` values).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import materialize

DEFAULT_ACCURACY = 10_000
# Largest number of distinct values one bracket may hand to a single task.
DEFAULT_MAX_BRACKET = 2_000_000
REFINE_GRID = 1000


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column | None:
    if not keys:
        return None
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                 null_safe: bool = True) -> DataFrame:
    """Equi-join on ``keys`` keeping one copy of each key column (NULL keys
    match each other when ``null_safe``).

    The right side is always a per-group table. No hint is given: Spark
    broadcasts it if its size in bytes allows (known before the run for a
    materialized table), else it runs a sort-merge join and AQE splits
    hot-key partitions. Without keys the right side is a one-row
    frame, broadcast explicitly (size bound known)."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    r = right.select(*[F.col(k).alias(f"__rk_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    eq = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    cond = reduce(lambda a, b: a & b,
                  [eq(left[k], r[f"__rk_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__rk_{k}" for k in keys])


def exact_percentiles(df: DataFrame, value: str, by: list[str] | tuple = (),
                      probs: list[float] | tuple = (0.5,), names: list[str] | None = None,
                      accuracy: int = DEFAULT_ACCURACY, exact: bool = True,
                      with_count: bool = False,
                      max_bracket: int | None = DEFAULT_MAX_BRACKET,
                      extra: dict[str, Column] | None = None) -> DataFrame:
    """Per group of ``by``: one column per probability (``names``), linear
    interpolation between order statistics, NULLs ignored. A group whose
    values are all NULL gets NULL.

    ``extra`` maps output names to aggregate expressions over ``df`` (all
    rows of the group, NULL values included); they are computed in the same
    pass as the sketch, so a caller's other statistics cost no extra scan.

    ``max_bracket`` bounds the distinct values any bracket passes to one
    task: when a group is large enough that ``10 n / accuracy`` could exceed
    it, the brackets are narrowed (``_refine``) before the final pass, and the
    query fails if they cannot be. The bracket table is materialized, so the
    sketch pass runs when this is called; the final pass checks that it sees as
    many values of every group as the sketch did and fails otherwise, so
    a table that changed in between cannot give a mixed answer."""
    by = list(by)
    probs = [float(p) for p in probs]
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    extra = dict(extra or {})
    xnames = list(extra)
    reserved = {"__v", "__n", "__sk", "__i", "__k", "__f", "__lo", "__hi", "__wide", "__dist"}
    if reserved & set(xnames):
        raise ValueError(f"extra names collide with internal columns: {reserved & set(xnames)}")
    xaggs = [e.alias(k) for k, e in extra.items()]
    vcol = F.col(value).cast("double")
    if not exact:
        agg = df.withColumn("__v", vcol).groupBy(*by).agg(
            F.count("__v").alias("__n"),
            F.percentile_approx("__v", probs, accuracy).alias("__q"), *xaggs)
        out = agg.select(*by, *([F.col("__n").alias("n")] if with_count else []), *xnames,
                         *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])
        return out

    base = df.select(*by, vcol.alias("__v")).filter(F.col("__v").isNotNull())
    margin = 4.0 / accuracy
    sk_probs: list[float] = []
    plan = []  # per prob: (sketch index of lo or None, sketch index of hi or None)
    for p in probs:
        lo_q, hi_q = p - margin, p + margin
        li = hi = None
        if lo_q > 0:
            li = len(sk_probs)
            sk_probs.append(lo_q)
        if hi_q < 1:
            hi = len(sk_probs)
            sk_probs.append(hi_q)
        plan.append((li, hi))

    aggs = [F.count("__v").alias("__n")]
    if sk_probs:
        aggs.append(F.percentile_approx("__v", sk_probs, accuracy).alias("__sk"))
    stats = df.withColumn("__v", vcol).groupBy(*by).agg(*aggs, *xaggs)

    n = F.col("__n")
    small = n < F.lit(accuracy)
    entries = []
    for i, (p, (li, hi)) in enumerate(zip(probs, plan)):
        pos = F.lit(p) * (n - 1).cast("double")
        k = F.floor(pos).cast("bigint")
        lo = F.lit(None).cast("double") if li is None else \
            F.when(small, F.lit(None).cast("double")).otherwise(F.col("__sk")[li])
        hv = F.lit(None).cast("double") if hi is None else \
            F.when(small, F.lit(None).cast("double")).otherwise(F.col("__sk")[hi])
        entries.append(F.struct(F.lit(i).alias("__i"), k.alias("__k"),
                                (pos - k).alias("__f"), lo.alias("__lo"), hv.alias("__hi")))
    brk = stats.select(*by, "__n", *xnames, F.inline(F.array(*entries)))
    if max_bracket:
        brk = _refine(base, brk, by, accuracy, max_bracket, carry=xnames)

    # One row per group with all its brackets, so a value meets one row.
    bounds = brk.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col(c))).alias(f"{c}{i}")
                                    for i in range(len(probs)) for c in ("__lo", "__hi")])
    j = join_on_keys(base, bounds, by)
    v = F.col("__v")
    below, above = F.lit(0), F.lit(0)  # bit i: the value lies below / above bracket i
    for i in range(len(probs)):
        below = below + F.when(v < F.col(f"__lo{i}"), 1 << i).otherwise(0)
        above = above + F.when(v > F.col(f"__hi{i}"), 1 << i).otherwise(0)
    everywhere = (1 << len(probs)) - 1
    outside = below.bitwiseOR(above) == everywhere
    cnt = (j.select(*by, below.alias("__b"), above.alias("__a"), F.when(~outside, v).alias("__vv"))
            .groupBy(*by, "__b", "__a", "__vv").agg(F.count(F.lit(1)).alias("__c")))
    # Only the counted values inside a bracket meet the single percentiles.
    sides = F.array(*[F.struct(F.lit(i).alias("__i"),
                               F.when(F.col("__b").bitwiseAND(F.lit(1 << i)) != 0, -1)
                                .when(F.col("__a").bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0).alias("__side"))
                      for i in range(len(probs))])
    per = cnt.select(*by, F.inline(sides), "__vv", "__c")
    per = (per.select(*by, "__i", "__side", F.when(F.col("__side") == 0, F.col("__vv")).alias("__vv"), "__c")
              .groupBy(*by, "__i", "__side", "__vv").agg(F.sum("__c").alias("__c")))
    per = join_on_keys(per, brk.select(*by, "__i", "__n", "__k", "__f"), by + ["__i"])
    keys = by + ["__i", "__n", "__k", "__f"]
    w = (Window.partitionBy(*by, "__i").orderBy("__side", "__vv")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = per.withColumn("__cum", F.sum("__c").over(w))
    k1, k2 = F.col("__k") + 1, F.col("__k") + 2
    inb = F.col("__side") == 0
    sel = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("__side") < 0, F.col("__cum"))).alias("__below"),
        F.max(F.when(F.col("__side") <= 0, F.col("__cum"))).alias("__upto_hi"), F.sum("__c").alias("__seen"),
        F.min(F.when(inb & (F.col("__cum") >= k1), F.col("__vv"))).alias("__a"),
        F.min(F.when(inb & (F.col("__cum") >= k2), F.col("__vv"))).alias("__b"),
    )
    a, b, f = F.col("__a"), F.col("__b"), F.col("__f")
    need = F.when(f > 0, k2).otherwise(k1)
    bad = ((F.coalesce(F.col("__below"), F.lit(0)) > F.col("__k"))
           | (F.coalesce(F.col("__upto_hi"), F.lit(0)) < F.least(need, F.col("__n"))))
    val = F.when(f > 0, a + f * (b - a)).otherwise(a)
    checked = (F.when(F.col("__seen") != F.col("__n"), F.raise_error(F.lit("the table changed between two passes")).cast("double"))
                .when(bad, F.raise_error(F.lit("percentile bracket missed the target rank")).cast("double")).otherwise(val))
    vals = sel.select(*by, "__i", checked.alias("__val"))
    piv = vals.groupBy(*by).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__val"))).alias(nm) for i, nm in enumerate(names)])
    if not xnames and not with_count and by:
        # Every group with a value reaches ``piv``; nothing to add back.
        return piv
    # Group list, counts and the caller's statistics come from the bracket
    # table (materialized: no further scan); groups whose values are all
    # NULL keep NULL percentiles.
    head = brk.filter(F.col("__i") == 0).select(*by, "__n", *xnames)
    out = join_on_keys(head, piv, by, "left")
    return out.select(*by, *([F.col("__n").alias("n")] if with_count else []), *xnames, *names)


def _refine(base: DataFrame, brk: DataFrame, by: list[str], accuracy: int,
            max_bracket: int, grid: int = REFINE_GRID, max_rounds: int = 8,
            carry: list[str] = ()) -> DataFrame:
    """Narrow brackets that may hold more than ``max_bracket`` distinct values.

    The bracket table (one row per group and percentile) is materialized, so
    the sketch pass runs once. If the a-priori bound ``10 n / accuracy + 2``
    fits everywhere nothing else happens (one scalar read of the small
    table). Otherwise each round is one pass over the rows inside the wide
    brackets: it counts the rows below each bracket and inside it, estimates
    the distinct values inside (HyperLogLog) and builds a sketch of the
    inside values on a fixed grid of ``grid`` + 1 probabilities; the new
    bracket is the pair of grid points that, with twice the sketch's rank
    error as margin, still encloses the target ranks. Each round shrinks a
    bracket about ``1 / (2 / grid + 6 / accuracy)`` times; it stops when
    every estimate fits. Brackets that are still too wide after
    ``max_rounds`` fail the query: no task ever receives more than
    ``max_bracket`` (estimated) distinct values.
    """
    brk = brk.withColumn("__wide", F.col("__n") * 10.0 / accuracy + 2 > max_bracket)
    brk = materialize(brk, "brackets")
    if brk.filter("__wide").isEmpty():
        return brk.drop("__wide")
    gprobs = [j / grid for j in range(grid + 1)]
    for _ in range(max_rounds):
        wide = brk.filter("__wide")
        j = join_on_keys(base, wide.select(*by, "__i", "__lo", "__hi"), by)
        v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
        below = lo.isNotNull() & (v < lo)
        inside = (lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi))
        agg = j.groupBy(*by, "__i").agg(
            F.count_if(below).alias("__below"), F.count_if(inside).alias("__cin"),
            F.approx_count_distinct(F.when(inside, v)).alias("__dist"),
            F.percentile_approx(F.when(inside, v), gprobs, accuracy).alias("__g"))
        cin = F.col("__cin").cast("double")
        r1 = (F.col("__k") - F.col("__below")).cast("double")
        slack = cin / accuracy
        a = F.floor((r1 - 2 * slack - 2) / cin * grid).cast("int")
        b = F.ceil((r1 + 1 + 2 * slack + 2) / cin * grid).cast("int")
        new_lo = F.when((a >= 0) & (a <= grid), F.greatest(lo, F.col("__g")[a])).otherwise(lo)
        new_hi = F.when((b >= 0) & (b <= grid), F.least(hi, F.col("__g")[b])).otherwise(hi)
        # Groups whose bracket already fits keep it.
        keep = F.col("__dist") <= max_bracket
        upd = join_on_keys(wide, agg, by + ["__i"], "left").select(
            *by, "__n", *carry, "__i", "__k", "__f",
            F.when(keep, lo).otherwise(F.coalesce(new_lo, lo)).alias("__lo"),
            F.when(keep, hi).otherwise(F.coalesce(new_hi, hi)).alias("__hi"),
            (~keep).alias("__wide"))
        brk = materialize(brk.filter(~F.col("__wide")).unionByName(upd), "brackets")
        if brk.filter("__wide").isEmpty():
            return brk.drop("__wide")
    raise ValueError(f"percentile brackets hold more than {max_bracket} distinct values after {max_rounds} rounds")


def column_medians(df: DataFrame, cols: list[str], exact: bool = True,
                   accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One-row frame ``__med_<c>`` with the median of each column.

    The columns are unpivoted to (column, value) so that one selection,
    grouped by column name, serves all of them."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__val")) for c in cols])))
    med = exact_percentiles(long, "__val", ["__col"], [0.5], ["__m"], accuracy, exact)
    return med.agg(*[F.max(F.when(F.col("__col") == c, F.col("__m"))).alias(f"__med_{c}") for c in cols])


def median_by(df: DataFrame, value: str, by: list[str], name: str = "median",
              exact: bool = True, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    return exact_percentiles(df, value, by, [0.5], [name], accuracy, exact)
