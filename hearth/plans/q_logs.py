"""Registered queries: event / API / notification / chat logs, text tagging,
observation payloads."""

from __future__ import annotations

from hearth.operators import logs as lg
from hearth.operators import text as tx
from hearth.operators import topn as tn
from hearth.operators import valuation as va
from hearth.operators.util import round_doubles
from hearth.plans.registry import register
from hearth.sources import files as fi
from hearth.sources import fixtures as sfx


@register("event_type_counts", """
SELECT event_type, count(*) AS count, max(timestamp) AS last_event,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM analytics_events GROUP BY event_type""")
def q_event_counts(spark, d):
    return round_doubles(lg.event_type_counts(sfx.analytics_events(spark, d)), 6)


@register("recent_events", """
SELECT id, event_type, event_data, user_id, timestamp FROM analytics_events
ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 50""")
def q_recent_events(spark, d):
    return tn.recent_events(sfx.analytics_events(spark, d))


@register("recent_api_calls", """
SELECT id, endpoint, method, status_code, round(response_time, 6) AS response_time, timestamp FROM api_logs
ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 100""")
def q_recent_api(spark, d):
    return round_doubles(tn.recent_api_calls(sfx.api_logs(spark, d), 100), 6)


@register("recent_api_calls_20", """
SELECT id, endpoint, method, status_code, round(response_time, 6) AS response_time, timestamp FROM api_logs
ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 20""")
def q_recent_api20(spark, d):
    return round_doubles(tn.recent_api_calls(sfx.api_logs(spark, d), 20), 6)


LAST100 = "(SELECT * FROM api_logs ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 100)"


@register("status_distribution", f"""
SELECT status_code, count(*) AS count FROM {LAST100} WHERE status_code IS NOT NULL GROUP BY status_code""")
def q_status(spark, d):
    return lg.status_distribution(sfx.api_logs(spark, d))


@register("endpoint_latency", f"""
SELECT endpoint, round(avg(response_time), 6) AS response_time FROM {LAST100}
WHERE endpoint IS NOT NULL GROUP BY endpoint ORDER BY avg(response_time) DESC NULLS LAST, endpoint LIMIT 10""")
def q_latency(spark, d):
    return round_doubles(lg.endpoint_latency(sfx.api_logs(spark, d)), 6)


@register("unread_counts", """
SELECT user_id, count(*) AS unread FROM notifications WHERE is_read = 0 GROUP BY user_id""")
def q_unread(spark, d):
    return lg.unread_counts(sfx.notifications(spark, d))


@register("recent_notifications", """
SELECT user_id, rn, id, title, message, type, is_read, created_at FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rn
  FROM notifications) WHERE rn <= 10""")
def q_recent_notifications(spark, d):
    return va.recent_notifications(sfx.notifications(spark, d), 10)


@register("recent_chat", """
SELECT session_id, rn, id, role, content, timestamp FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS INTEGER) AS rn
  FROM chat_history) WHERE rn <= 5""")
def q_recent_chat(spark, d):
    return va.recent_chat(sfx.chat_history(spark, d), 5)


def _intent_sql() -> str:
    from hearth.functions.text import FALLBACK_INTENT, INTENT_KEYWORDS
    whens = []
    for name, words in INTENT_KEYWORDS:
        cond = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        whens.append(f"WHEN {cond} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{FALLBACK_INTENT}' END"


@register("intent", f"SELECT id, text, {_intent_sql()} AS intent, substr(text, 1, 50) AS excerpt FROM messages")
def q_intent(spark, d):
    return tx.tag_intents(sfx.messages(spark, d))


@register("intent_conversations", f"""
SELECT conv_id * 1000 + turn AS id, text, {_intent_sql()} AS intent, substr(text, 1, 50) AS excerpt
FROM conversations""")
def q_intent_conv(spark, d):
    from pyspark.sql import functions as F
    from hearth.sources.tables import read_table
    c = read_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return tx.tag_intents(c)


@register("intent_basic", """
SELECT id, text, CASE WHEN contains(lower(text), 'investment') THEN 'investment'
                      WHEN contains(lower(text), 'luxury') THEN 'luxury' ELSE 'market' END AS intent
FROM messages""")
def q_intent_basic(spark, d):
    return tx.tag_intents_basic(sfx.messages(spark, d))


@register("flatten_observation", """
SELECT id, round(temperature, 6) AS temperature, round(feels_like, 6) AS feels_like, humidity, pressure,
       description, wind_speed, icon FROM observations_flat""")
def q_flatten(spark, d):
    return round_doubles(fi.flatten_observation(sfx.observations(spark, d)), 6)


@register("event_type_counts_stream", """
SELECT event_type, count(*) AS count, max(ts) AS last_event,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM events GROUP BY event_type""")
def q_event_counts_stream(spark, d):
    from hearth.streaming.events import latest_counts, run_event_counts
    # The glob fits a single file and a folder of part files.
    out = run_event_counts(spark, f"{d.rstrip('/')}/events.parquet*")
    return round_doubles(latest_counts(spark, out), 6)


@register("status_distribution_all", f"""
SELECT status_code, count(*) AS count FROM {LAST100} GROUP BY status_code""")
def q_status_all(spark, d):
    """Failed calls (no status) counted as their own group."""
    return lg.status_distribution(sfx.api_logs(spark, d), keep_missing=True)
