"""Batch tagging of logged messages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hearth.functions.text import intent, intent_basic, prompt_excerpt


def tag_intents(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("id", col, intent(col).alias("intent"),
                     prompt_excerpt(col).alias("excerpt"))


def tag_intents_basic(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("id", col, intent_basic(col).alias("intent"))
