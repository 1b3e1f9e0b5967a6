"""URL filter: an exact cascade of Bloom filters over host-and-path rules.

A rule is a host and a path prefix (``example.org/es/``); it fits its host,
every subdomain, and paths that start with its path. A url's *candidate
keys* are the strings such a rule could be written as: one per *shape*
(number of host labels, path length) that occurs in the rule list. A list is
stored as a cascade of bit arrays:

* level 0 holds the listed keys;
* level 1 holds the keys of the corpus's universe that level 0 accepts
  although they are not listed;
* level 2 holds the listed keys that level 1 accepts, and so on, until a
  level has no false positive.

Because the universe holds every candidate key of the corpus, membership of
any of its keys is exact: the parity of the first level that refuses it. The
application needs no join; the levels are folded array literals.

Rules are given as Python pairs or, for lists of any length, as a table of hosts
and paths. Of a table only the keys that occur in the universe are encoded (no
other can be asked for), so a cascade grows with the listed keys that the corpus
could match, not with the list.

Only DataFrame functions are used. What the driver holds is the bit arrays:
about 1.5 * log2(universe / listed) bits a listed key, checked against
``max_bits``. False-positive keys stay in a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import Masked, ascii_lower, literal_array, literal_table, stored

ALLOW, BLOCK = "allow", "block"
#: Upper bound of all levels of one list, in bits (16 MB).
MAX_BITS = 1 << 27
MAX_LEVELS = 64
#: Most shapes of a table of rules: a url has one candidate key for each.
MAX_SHAPES = 1 << 10

Rules = list[tuple[str, str]] | DataFrame


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path up to ``? #``.
    A url that is null or has no ``://`` has both empty."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _table_rules(rules: DataFrame) -> DataFrame:
    """(host, path) of a table of rules; rows without a host hold no rule, a null path is the empty one."""
    return (rules.select(F.col("host").cast("string").alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"))
            .filter("host IS NOT NULL AND host <> ''"))


def shapes_of(rules: Rules) -> list[tuple[int, int]]:
    """The (host labels, path length) pairs of the rules. Of a table only the distinct pairs reach the driver;
    ValueError if they are more than ``MAX_SHAPES``."""
    if not isinstance(rules, DataFrame):
        return sorted({(host.count(".") + 1, len(path)) for host, path in rules})
    pairs = _table_rules(rules).select(_labels(F.col("host")), F.length("path")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(pairs) > MAX_SHAPES:
        raise ValueError(f"rules have more than {MAX_SHAPES} pairs of host labels and path length; split the list")
    return sorted(tuple(r) for r in pairs)


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the keys of one url, one per shape that it is long enough for."""
    labels = _labels(host)
    keys = [F.when((F.length(host) > 0) & (labels >= n) & (F.length(path) >= size),
                   F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)))
            for n, size in shapes]
    if not keys:
        return F.expr("cast(array() as array<string>)")
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        test = F.lit(False)
        for i in reversed(range(len(self.levels))):
            test = _accepts(self.levels[i], key, i) & ~test
        return test


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _accepts(level: Level, key: Column, number: int) -> Column:
    words, test = literal_array(level.words), F.lit(True)
    for p in _positions(key, number, level.bits, level.hashes):
        word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
        bit = F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        test = test & (bit == 1)
    return test


def _build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """One bit array of the ``n`` keys in column ``key``: bits are OR-ed word by word, so the driver
    receives words, never keys."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = max(1, round(bits / max(n, 1) * math.log(2))) if n else 1
    hashes = min(hashes, 30)
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    rows = (pos.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("v"))).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(bits, hashes, tuple(words))


def build_cascade(spark: SparkSession, listed: list[str] | DataFrame, universe: DataFrame, n_universe: int,
                  max_bits: int = MAX_BITS) -> Cascade:
    """Cascade of ``listed`` (keys, or a table of them in column ``key``) over ``universe`` (distinct keys
    in column ``key``).

    The first level's rate is sqrt(1/2) * listed / universe, so that about as many keys reach level 1
    as are listed; later levels use 1/2. Raises ValueError if a level would exceed ``max_bits``: such
    a list is to be split into several filters."""
    if isinstance(listed, DataFrame):
        inside = stored(universe.join(listed, "key", "left_semi"), "listed-keys")
        n = inside.count()
    else:
        listed = sorted(set(listed))
        n = len(listed)
        inside = literal_table(spark, [(k,) for k in listed], "key string")
    if not n:
        return Cascade(())
    total, rate = n, min(0.5, math.sqrt(0.5) * n / max(n_universe, n))
    outside = universe.join(inside, "key", "left_anti")
    keys, levels, other = inside, [], outside
    for number in range(MAX_LEVELS):
        if n * -math.log(rate) / math.log(2) ** 2 + sum(x.bits for x in levels) > max_bits:
            raise ValueError(f"cascade of {total} keys exceeds {max_bits} bits")
        level = _build_level(keys, n, rate, number)
        levels.append(level)
        wrong = stored(other.filter(_accepts(level, F.col("key"), number)), "cascade-level")
        n = wrong.count()
        if n == 0:
            return Cascade(tuple(levels))
        keys, other, rate = wrong, keys, 0.5
    raise ValueError(f"no exact cascade within {MAX_LEVELS} levels")


def filter_urls(pages: DataFrame, allow: Rules, block: Rules, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule (the longest fitting rule as ``host + path``, else null) and
    verdict (its list's name, else ``default``).

    ``allow`` and ``block`` are pairs (host, path) or tables with columns ``host`` and ``path``; hosts in lower
    case. In a table, repeated rules count once, rows without a host hold no rule, and a null path is empty.

    Null, empty and malformed urls fit no rule. Repeated rows are judged one by one; among rules of
    equal length the one with the longer host wins; a rule on both lists blocks. An empty table gives
    an empty table. Columns of ``pages`` called like an output column are replaced."""
    spark, shapes = pages.sparkSession, sorted({*shapes_of(allow), *shapes_of(block)})
    out = ["host", "path", "rule", "verdict"]
    own = Masked(pages.drop(*[c for c in out if c != url]))
    parts = own.df.select("*", *(c.alias(n) for c, n in zip(split_url(F.col(own.name[url])), out)))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = stored(parts.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    n = universe.count()
    lists = {BLOCK: block, ALLOW: allow}

    def keys_of(rules: Rules) -> list[str] | DataFrame:
        if isinstance(rules, DataFrame):
            return _table_rules(rules).select(F.concat("host", "path").alias("key"))
        return [h + p for h, p in rules]

    cascades = {v: build_cascade(spark, keys_of(rules), universe, n) for v, rules in lists.items()}

    def fits(verdict: str) -> Column:
        return F.transform(F.filter(keys, cascades[verdict].contains),
                           lambda k: F.struct(F.length(k).alias("n"), F.instr(F.concat(k, F.lit("/")), "/").alias("h"),
                                              F.lit(verdict).alias("verdict"), k.alias("rule")))

    best = F.array_max(F.concat(*(fits(v) for v in lists)))
    return own.back(parts.withColumn("_best", best), {
        "host": F.col("host"), "path": F.col("path"), "rule": F.col("_best.rule"),
        "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
