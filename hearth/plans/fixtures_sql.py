"""The derived fixtures as DuckDB SQL, for the oracle side of each check.

Each entry is ``name -> (dependencies, body)``; ``with_fixtures`` prepends the
CTEs a query text mentions, in dependency order.
"""

from __future__ import annotations

import re

FIXTURES: dict[str, tuple[list[str], str]] = {
    "raw_sales": ([], """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 101 = 7 THEN 'bad-date'
       ELSE strftime(o_orderdate, '%Y%m%dT%H%M%S') END AS date,
  o_totalprice * 4.0E0 AS price,
  CAST(1 + (o_custkey + o_orderkey) % 6 AS INTEGER) AS bedrooms,
  1.0E0 + (o_orderkey % 13) * 0.25E0 AS bathrooms,
  CASE WHEN o_orderkey % 997 = 1 THEN CAST(0 AS BIGINT)
       ELSE CAST(400 + floor(o_totalprice / 110.0E0) + (o_orderkey * 37) % 1200 AS BIGINT) END AS sqft_living,
  CAST(1000 + (o_orderkey * 53) % 9000 AS BIGINT) AS sqft_lot,
  1.0E0 + (o_orderkey % 5) * 0.5E0 AS floors,
  CAST(CASE WHEN o_orderkey % 17 = 3 THEN NULL WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS INTEGER) AS waterfront,
  CAST(CASE WHEN o_orderkey % 29 = 5 THEN NULL ELSE o_orderkey % 5 END AS INTEGER) AS view,
  CAST(CASE WHEN o_orderkey % 23 = 4 THEN NULL ELSE 1 + o_custkey % 5 END AS INTEGER) AS condition,
  CAST(least(13, 3 + floor(o_totalprice / 60000.0E0) + o_custkey % 4) AS INTEGER) AS grade,
  CAST(1900 + o_custkey % 116 AS INTEGER) AS yr_built,
  CAST(CASE WHEN o_orderkey % 20 = 0 THEN 1985 + o_orderkey % 31 ELSE 0 END AS INTEGER) AS yr_renovated,
  CAST(CASE WHEN o_orderkey = 0 THEN 98199 ELSE 98001 + c_nationkey END AS INTEGER) AS zipcode,
  47.1E0 + (o_custkey % 700) / 1000.0E0 AS lat,
  -122.5E0 + (o_orderkey % 900) / 1000.0E0 AS long,
  CAST(400 + (o_orderkey * 37) % 1200 AS BIGINT) AS sqft_above,
  CAST((o_orderkey % 3) * 250 AS BIGINT) AS sqft_basement
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "sales": (["raw_sales"], """
SELECT id, CAST(try_strptime(date, '%Y%m%dT%H%M%S') AS TIMESTAMP) AS date, price, bedrooms, bathrooms,
  sqft_living, sqft_lot, floors, coalesce(waterfront, 0) AS waterfront, coalesce(view, 0) AS view,
  coalesce(condition, 0) AS condition, grade, yr_built, yr_renovated, zipcode, lat, long,
  sqft_above, sqft_basement,
  price / CAST(CASE WHEN sqft_living IS NULL THEN NULL ELSE greatest(sqft_living, 1) END AS DOUBLE) AS price_per_sqft,
  CAST(year(try_strptime(date, '%Y%m%dT%H%M%S')) AS INTEGER) AS year,
  CAST(month(try_strptime(date, '%Y%m%dT%H%M%S')) AS INTEGER) AS month
FROM raw_sales"""),
    "sales_dup": (["raw_sales"], """
SELECT * FROM raw_sales UNION ALL SELECT * FROM raw_sales WHERE id % 50 = 0"""),
    "analytics_events": ([], """
SELECT event_id AS id, event_type, props AS event_data, user_id, ts AS timestamp FROM events"""),
    "api_logs": ([], """
SELECT event_id AS id, '/api/v1/' || event_type AS endpoint,
  CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CAST(CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status_code,
  abs(value) / 100.0E0 AS response_time,
  '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS client_ip,
  ts AS timestamp
FROM events"""),
    "notifications": ([], """
SELECT event_id AS id, user_id, event_type AS title, 'event ' || CAST(event_id AS VARCHAR) AS message,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS type,
  CAST(event_id % 2 AS INTEGER) AS is_read, ts AS created_at
FROM events"""),
    "chat_history": ([], """
SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, text AS content, turn AS timestamp FROM conversations"""),
    "messages": ([], """
SELECT event_id AS id,
  ['Hello there', 'How much does a house cost', 'What are the best investment opportunities?',
   'What are the current price trends?', 'Show me the market overview', 'Compare two homes',
   'Which areas have the best investment potential?', 'Explain the random forest algorithm',
   'What can you do', 'good job', 'xyz', 'Nearby area'][CAST(event_id % 12 AS INTEGER) + 1] AS text
FROM events"""),
    "observations_flat": ([], """
SELECT event_id AS id,
  value AS temperature, value - 1.5E0 AS feels_like,
  CAST(event_id % 100 AS DOUBLE) AS humidity, CAST(1000 + event_id % 40 AS DOUBLE) AS pressure,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' Sky' END AS description,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 15 AS DOUBLE) END AS wind_speed,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 10 AS VARCHAR) || 'd' END AS icon
FROM events"""),
}


def with_fixtures(sql: str) -> str:
    """Prepend the fixture CTEs that ``sql`` (and its fixtures) reference."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in FIXTURES[name][0]:
            visit(dep)
        order.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n][1].strip()})" for n in order)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
