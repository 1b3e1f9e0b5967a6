"""Mixing to target weights with soft domain membership.

1. A multinomial logistic regression (Spark ML) over the words that depend most on
   the label and a few text statistics is fitted on labelled rows and gives every document its
   posterior probability of each domain. At most ``MAX_LABELLED`` labelled rows are
   used, those with the smallest key hash.
2. Document rates r >= 0 are fitted so that the expected domain token totals
   A_k = sum of r * p_k * tokens match the targets, by accelerated projected gradient descent on
   sum_k (A_k - target_k)^2 / (2 S_k T); S_k is what a domain has, T the sum. In
   the metric weighted by tokens the step for a document is sum_k p_k (A_k - target_k) / S_k,
   and the curvature is at most 1. A round is one pass over (tokens, posteriors): its
   sums are added by Spark, and the K residuals go back as literals.
3. A rate becomes floor(rate) copies, and one more with the rest's probability, drawn
   by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import SPACE, Masked, ascii_lower, stored

MAX_LABELLED = 20_000
#: Words of the model's vocabulary, and texts that each must be in.
WORDS, MIN_DOCUMENTS = 1000, 5
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MAX_ROUNDS = 120
TOLERANCE = 1e-5
#: Rounds in a row in which the totals move by less than a hundredth of the tolerance: they have settled.
STILL_ROUNDS = 3


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_LETTERS), "")


def _features(rows: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """``rows`` with n_tokens (words between white space) and features (which words of ``vocabulary`` the
    text has, and statistics)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def share(chars: str) -> Column:
        return F.log1p(100.0 * (F.size(F.split(t, f"[{chars}]", -1)) - 1) / F.greatest(F.length(t), F.lit(1)))

    out = rows.withColumns({"_w": _words(t), "n_tokens": F.size(F.array_remove(F.split(t, SPACE + "+"), "")).cast("bigint")})
    out = out.withColumns({
        "_size": F.log1p(F.size("_w").cast("double")), "_symbols": share(r"#*$%&<>|"), "_bangs": share("!"), "_capitals": share("A-Z"),
        "_distinct": F.size(F.array_distinct("_w")) / F.greatest(F.size("_w"), F.lit(1)),
    })
    out = CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="_w", outputCol="_tf", binary=True).transform(out)
    numbers = ["_size", "_symbols", "_bangs", "_capitals", "_distinct"]
    return VectorAssembler(inputCols=["_tf", *numbers], outputCol="features").transform(out).drop("_w", "_tf", *numbers)


def _vocabulary(train: DataFrame, n: int) -> list[str]:
    """The ``n`` words whose presence depends most on the label (chi-square over the labels, at least
    ``MIN_DOCUMENTS`` texts with the word)."""
    per = {r.label: r["count"] for r in train.groupBy("label").count().collect()}  # one row per domain
    total = sum(per.values())
    words = train.select("label", F.explode(F.array_distinct(_words(F.col("_text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == c).alias(f"n{i}") for i, c in enumerate(sorted(per))))
    score = F.lit(0.0)
    for i, c in enumerate(sorted(per)):
        expected = F.col("n") * (per[c] / total)
        score = score + (F.col(f"n{i}") - expected) ** 2 / expected
    best = counts.filter(F.col("n") >= MIN_DOCUMENTS).select("word", score.alias("s")).orderBy(F.desc("s"), "word").limit(n)
    return [r.word for r in best.collect()]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text",
               max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(key, text_hash, n_tokens, p): p is the probability of each of ``domains``, in their order.

    ``labelled``: (key, domain); rows of other domains are left out. With labelled rows of one domain
    only, or none, every document gets the same p: that domain, or equal parts."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    marked = labelled.filter(number > 0).select(F.col(key).alias("_key"), (number - 1).cast("double").alias("label"))
    # The bound of this table is max_labelled rows.
    sample = stored(marked.orderBy(F.xxhash64("_key"), "label").limit(max_labelled), "mixing-labels")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(text).alias("text_hash"))
    train = stored(rows.join(F.broadcast(sample), "_key").select("_text", "label"), "mixing-train")
    classes = [r.label for r in train.select("label").distinct().collect()]
    if len(classes) < 2:
        p = [float(i in classes) if classes else 1 / len(domains) for i in range(len(domains))]
        n = F.size(F.array_remove(F.split("_text", SPACE + "+"), "")).cast("bigint")
        out = rows.select("_key", "text_hash", n.alias("n_tokens"), F.array(*map(F.lit, p)).alias("p"))
    else:
        vocabulary = _vocabulary(train, WORDS)
        known = stored(_features(train, "_text", vocabulary).select("features", "label"), "mixing-features")
        model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(known)
        scored = model.transform(_features(rows, "_text", vocabulary).select("_key", "text_hash", "n_tokens", "features"))
        p = vector_to_array("probability")
        # A domain that no label names lies beyond the model's classes.
        p = F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0))) if model.numClasses < len(domains) else p
        out = scored.select("_key", "text_hash", "n_tokens", p.alias("p"))
    return out.withColumnRenamed("_key", key)


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, the point ahead of them where the next step is taken) after ``steps``. The steps of all
    rounds are replayed, so no round has to store a rate per document."""
    rate = ahead = np.ones(len(p))
    for i, s in enumerate(steps):
        new = np.maximum(0.0, ahead - p @ s)
        ahead = new + i / (i + 3) * (new - rate)  # Nesterov's weights
        rate = new
    return rate, ahead


def _totals(rows: DataFrame, n_domains: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain under the rates that ``steps`` lead to, and at the point ahead."""
    names = [f"a{i}" for i in range(2 * n_domains)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * n_domains)
        for batch in batches:
            if batch.num_rows:
                t = batch.column("n_tokens").to_numpy().astype(float)
                p = batch.column("p").flatten().to_numpy().reshape(len(t), -1)
                total += np.concatenate([(x * t) @ p for x in _rates(p, steps)])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

    sums = rows.select("n_tokens", "p").mapInArrow(run, ", ".join(f"{n} double" for n in names))
    out = np.array([x or 0.0 for x in sums.agg(*(F.sum(n) for n in names)).first()])
    return out[:n_domains], out[n_domains:]


def fit_rates(rows: DataFrame, weights: list[float], keep: int, max_rounds: int = MAX_ROUNDS,
              tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, totals, targets) for ``rows`` (n_tokens, p). The corpus is as large as keeps domain ``keep``
    whole: its target is what it has. A domain without tokens gets no target."""
    n = len(weights)
    have, ahead = _totals(rows, n, [])
    w = np.where(have > 0, np.array(weights, float), 0.0)
    if have[keep] <= 0 or w[keep] <= 0:
        return [], have, have
    targets = w / w[keep] * have[keep]
    steps, now, before, still = [], have, np.full(n, np.inf), 0
    goal = tolerance * targets.sum()
    for _ in range(max_rounds):
        # Targets beyond reach: the totals settle at the nearest ones. One small step may be a turning point of the accelerated
        # steps; several in a row are none.
        still = still + 1 if np.abs(now - before).max() <= goal / 100 else 0
        if np.abs(now - targets).max() <= goal or still >= STILL_ROUNDS:
            break
        steps.append(np.where(have > 0, (ahead - targets) / np.where(have > 0, have, 1.0), 0.0))
        before, (now, ahead) = now, _totals(rows, n, steps)
    return steps, now, targets


def fit_state(totals: np.ndarray, targets: np.ndarray, rounds: int, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> str:
    """How a fit ended: ``targets`` (met), ``nearest`` (out of reach, the totals no longer move) or ``unsettled`` (rounds used up)."""
    if np.abs(totals - targets).max(initial=0) <= tolerance * targets.sum():
        return "targets"
    return "nearest" if rounds < max_rounds else "unsettled"


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep: str, key: str = "doc_id",
        text: str = "text", **options) -> DataFrame:
    """(key, text_hash, n_tokens, p, rate, copies, totals, targets, fit) per row of ``docs``; ``fit`` says how the fit ended
    (``fit_state``), the same on all rows.

    ``labelled``: (key, domain). ``weights``: the wanted share of tokens of each domain; ``keep``: the domain
    that sets the size. Tokens are words. Null and empty texts have no tokens, weigh nothing, and get a rate by
    their posterior like any other. Equal rows get equal rates and copies. An empty table, or one without a
    token of ``keep``, leaves all rates 1. Other columns are ignored."""
    domains = list(weights)
    rows = stored(posteriors(docs, labelled, domains, key, text, **options), "mixing-posteriors")
    steps, totals, targets = fit_rates(rows, list(weights.values()), domains.index(keep))

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.array(p.tolist()).reshape(len(p), -1), steps)[0])

    uniform = F.pmod(F.xxhash64(F.col(key), "text_hash", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    return (rows.withColumn("rate", rate("p"))
            .withColumn("copies", (F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
            .withColumns({"totals": F.array(*map(F.lit, map(float, totals))), "targets": F.array(*map(F.lit, map(float, targets))),
                          "fit": F.lit(fit_state(totals, targets, len(steps)))}))


def apply_mix(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row as often as its copies say (0: not at all)."""
    own = Masked(docs)
    few = stored(mixed.groupBy(F.col(key).alias("_k"), F.col("text_hash").alias("_h")).agg(F.first("copies").alias("_copies")).filter("_copies > 0"), "mixing-copies")
    out = own.df.join(few, F.col(own.name[key]).eqNullSafe(F.col("_k")) & F.xxhash64(own.name[text]).eqNullSafe(F.col("_h")))
    return own.back(out.select(*own.name.values(), F.explode(F.sequence(F.lit(1), "_copies"))))
