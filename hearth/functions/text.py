"""Message intent tagging as Column expressions.

The first keyword list with a substring hit in the lower-cased text decides;
substring (not word) matching and list order are part of the semantics
("which" contains "hi", so it is a greeting).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent keyword lists, in decision order.
INTENT_KEYWORDS = [
    ("greeting", ["hello", "hi", "hey", "greetings"]),
    ("price", ["price", "cost", "worth", "value", "expensive", "cheap"]),
    ("invest", ["invest", "investment", "opportunity", "score", "return"]),
    ("trend", ["trend", "forecast", "predict", "future", "market"]),
    ("compare", ["compare", "difference", "versus", "vs", "better"]),
    ("map", ["map", "location", "area", "zipcode", "neighborhood"]),
    ("model", ["model", "ai", "algorithm", "predict", "machine learning", "ml"]),
    ("help", ["help", "what can you do", "features", "capability"]),
    ("thanks", ["thank", "thanks", "appreciate", "good job"]),
]
FALLBACK_INTENT = "fallback"

# The earlier app's three-way rule.
BASIC_INTENTS = [("investment", "investment"), ("luxury", "luxury")]
BASIC_FALLBACK = "market"


def _any_contains(text: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def intent(col: str = "text") -> Column:
    t = F.lower(F.col(col))
    expr = None
    for name, words in INTENT_KEYWORDS:
        cond = _any_contains(t, words)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(FALLBACK_INTENT))


def intent_basic(col: str = "text") -> Column:
    t = F.lower(F.col(col))
    expr = None
    for word, name in BASIC_INTENTS:
        cond = t.contains(word)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(BASIC_FALLBACK))


def prompt_excerpt(col: str = "text", n: int = 50) -> Column:
    """The fallback answer quotes the first ``n`` characters of the prompt."""
    return F.substring(F.col(col), 1, n)
