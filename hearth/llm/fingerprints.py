"""Document fingerprints by consistent weighted sampling (JVM side only).

A document is a set of weighted terms: its words (A-Z lower-cased), weighted by
how often they occur. Each of ``SAMPLES`` samples draws for every term, from a hash of
(term, sample) alone, r and c from Gamma(2, 1) and beta from Uniform(0, 1), and takes for weight S

    t = floor(ln S / r + beta),   ln a = ln c - r (t - beta + 1);

the term with the smallest a, with its t, is the sample. Two documents agree in a sample with the probability
sum(min(S, S')) / sum(max(S, S')), their generalised Jaccard similarity, so the share of
equal samples estimates it. Gamma draws are read from a table of ``DRAWS``
quantiles; beta has 40 bits.

A sample is one long: ln a in steps of 2^-24 above, 32 bits of the term's hash below, so a plain ``min`` finds the smallest a
and carries (term, t). The fingerprint keeps 16 bits of each sample, never 0; a text without words has
zeros, and is like another such text only.

Every text's terms are exploded and aggregated again within its own task: the rows
are grouped by keys that hold the partitioning, so texts move at most once.

``edited`` sets every document beside the next one in ascending key order: keys
are cut into blocks of equal numbers of rows by Spark's range partitioner
(only keys and hashes move), every document goes to its block, the
first of a block also to the end of the block before. Equal keys are ordered by
their text's hash, null keys come last; wholly equal rows are interchangeable and stay in one block.

Null and empty texts have no words; repeated rows are rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import LOWER, UPPER, literal_array

SAMPLES = 64
#: Quantiles of Gamma(2, 1) that draws are read from (a power of two).
DRAWS = 1024
#: Blocks of documents per shuffle partition, and at most (their bounds are literals in the plan).
BLOCKS_EACH, MAX_BLOCKS = 4, 8192
SEED = 12

_ID_BITS, _BETA_BITS, _STEP_BITS = 16, 40, 24


def gamma_quantiles(n: int = DRAWS) -> list[float]:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), at the middles of n equal parts."""
    out = []
    for i in range(n):
        low, high = 0.0, 64.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < (i + 0.5) / n else (low, x)
        out.append(low)
    return out


def _once(c: Column, name: str) -> Column:
    """A generator of one row, so that what refers to the column does not repeat the expression."""
    return F.explode(F.array(c)).alias(name)


def _literal(values: list[float], when: Column) -> Column:
    """A literal array that is laid out as primitives once per row (the condition always holds)."""
    text = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    return F.slice(text, 1, F.when(when, F.lit(len(values))).otherwise(0))


def _sample(k: int, secret: int) -> Column:
    """The packed (ln a, term) of a term (_term: hash, _log: ln of its weight) in one sample; null without a term."""
    term = F.col("_term")
    drawn = F.xxhash64(term.bitwiseXOR(F.lit(secret)))
    first = F.shiftrightunsigned(drawn, 64 - DRAWS.bit_length() + 1).cast("int")
    second = drawn.bitwiseAND(F.lit(DRAWS - 1)).cast("int")
    beta = term.bitwiseXOR(F.lit(secret)).bitwiseAND(F.lit(2 ** _BETA_BITS - 1)) * F.lit(2.0 ** -_BETA_BITS)
    log_a = F.get("_log_c", second) - F.get("_r", first) * (F.floor(F.col("_log") * F.get("_per_r", first) + beta) - beta + 1)
    # ln a lies above -64: at most ln c minus ln of a weight below e^40 and the largest r.
    steps = ((log_a + 64) * F.lit(2.0 ** _STEP_BITS)).cast("bigint")
    return F.shiftleft(steps, 32).bitwiseOR(term.bitwiseAND(F.lit(2 ** 32 - 1)))


def signatures(rows: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` (which tell the rows apart) and ``fp``, the samples' ids (array<bigint>)."""
    spaces = "\t\n\x0b\x0c\r"
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER + spaces, LOWER + " " * len(spaces))
    hashes = F.sort_array(F.transform(F.filter(F.split(lower, " "), lambda w: w != ""), lambda w: F.xxhash64(w)))
    d = rows.select(*keys, _once(hashes, "_hashes"))
    n = F.size("_hashes")
    fresh = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("_hashes", i - 1) != F.get("_hashes", i - 2)))
    d = d.select(*keys, "_hashes", _once(F.when(n > 0, fresh).otherwise(F.expr("cast(array() as array<int>)")), "_at"))
    terms = F.transform("_at", lambda i, j: F.struct(
        F.get("_hashes", i - 1).alias("_term"),
        F.ln((F.coalesce(F.get("_at", j + 1), F.size("_hashes") + 1) - i).cast("double")).alias("_log")))
    draws, always = gamma_quantiles(), F.size("_at") >= 0
    d = d.select(*keys, terms.alias("_terms"), _literal(draws, always).alias("_r"), _literal([1 / r for r in draws], always).alias("_per_r"),
                 _literal([math.log(c) for c in draws], always).alias("_log_c"))
    d = d.select(*keys, "_r", "_per_r", "_log_c", F.inline_outer("_terms"))
    r = random.Random(SEED)
    secrets = [r.getrandbits(63) for _ in range(samples)]
    best = d.groupBy(*keys).agg(*[F.min(_sample(k, s)).alias(f"_m{k}") for k, s in enumerate(secrets)])
    ids = [F.coalesce(F.pmod(F.xxhash64(f"_m{k}"), F.lit(2 ** _ID_BITS - 1)) + 1, F.lit(0)) for k in range(samples)]
    return best.select(*keys, F.array(*ids).alias("fp"))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), _ID_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (hex text), fp (ids of the samples)."""
    rows = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    return signatures(rows, ["_key", "_row"], "_text", samples).select(F.col("_key").alias(key), as_text(F.col("fp")).alias("fingerprint"), "fp")


def _order(key: str, text: str) -> list[Column]:
    return [F.col(key).isNull().cast("int").alias("_no_key"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("_key"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash")]


def block_bounds(docs: DataFrame, key: str, text: str, blocks: int) -> list[tuple[int, int, int]]:
    """The first (no key, key, hash) of every block, ascending; at most ``blocks`` rows come to the driver."""
    place = ["_no_key", "_key", "_hash"]
    ranged = docs.select(*_order(key, text)).repartitionByRange(blocks, *place)
    first = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*place)).alias("first"))
    return sorted({tuple(r["first"]) for r in first.collect()})


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """(_block, _extra, _no_key, _key, _hash, _row, _text, _next): every document with the text of the next one (the last has
    the first). Rows with _extra = 1 repeat the first document of the next block and have no _next. All rows of a
    block are in one partition, hashed by _block."""
    spark = docs.sparkSession
    blocks = blocks or min(BLOCKS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BLOCKS)
    bounds = block_bounds(docs, key, text, blocks) or [(0, 0, 0)]
    many = len(bounds)
    arrays = [literal_array(b[i] for b in bounds) for i in range(3)]

    def bound(at: Column) -> Column:
        return F.struct(*[F.get(a, at) for a in arrays])

    # Largest block whose bound is not above the row: steps of falling powers of two.
    mine = F.struct(F.col("_no_key").cast("bigint"), "_key", "_hash")
    powers = literal_array(2 ** i for i in reversed(range(many.bit_length()))).cast("array<int>")
    found = F.aggregate(powers, F.lit(0), lambda at, step: F.when((at + step < many) & (bound(at + step) <= mine), at + step).otherwise(at))
    rows = docs.select(*_order(key, text), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("*", _once(found, "_found"))
    own = F.struct(F.col("_found").alias("_block"), F.lit(0).alias("_extra"))
    before = F.struct(F.pmod(F.col("_found") - 1 + many, F.lit(many)).alias("_block"), F.lit(1).alias("_extra"))
    rows = rows.select(F.inline(F.when(bound(F.col("_found")) == mine, F.array(own, before)).otherwise(F.array(own))),
                       "_no_key", "_key", "_hash", "_row", "_text")
    order = Window.partitionBy("_block").orderBy("_extra", "_no_key", "_key", "_hash", "_row")
    return rows.withColumn("_next", F.lead("_text").over(order))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, blocks: int | None = None) -> DataFrame:
    """Per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document."""
    d = beside_next(docs, key, text, blocks)
    half = (F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("_next", F.lit(1), half))
    place = ["_block", "_extra", "_no_key", "_key", "_hash", "_row"]
    d = d.select(*place, F.length("_text").cast("bigint").alias("n_chars"), "_text",
                 F.explode(F.array(F.when(F.col("_extra") == 0, edited))).alias("_edited"))
    d = d.select(*place, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.inline(F.filter(F.array(
        F.struct(F.lit(0).alias("_version"), F.col("_text").alias("_words")),
        F.struct(F.lit(1).alias("_version"), F.col("_edited").alias("_words"))), lambda v: v["_words"].isNotNull())))
    s = signatures(d, [*place, "n_chars", "edited_sha256", "_version"], "_words", samples)
    order = Window.partitionBy("_block").orderBy("_extra", "_no_key", "_key", "_hash", "_row", "_version")
    s = s.select("*", F.lead("fp", 1).over(order).alias("_of_edited"), F.lead("fp", 2).over(order).alias("_of_next"))
    return s.filter((F.col("_extra") == 0) & (F.col("_version") == 0)).select(
        F.when(F.col("_no_key") == 0, F.col("_key")).alias(key), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("_of_edited")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("_of_edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("_of_next")).alias("near_next"))
