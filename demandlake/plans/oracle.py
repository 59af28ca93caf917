"""DuckDB twins of the fixtures, prefixed to every oracle query as CTEs."""

from __future__ import annotations

FIXTURE_CTES = """
WITH fx AS (
  SELECT event_id, ts AS datetime,
    CAST(1 + user_id % 4 AS INTEGER) AS season,
    CAST(CASE WHEN event_id % 33 = 0 THEN 1 ELSE 0 END AS INTEGER) AS holiday,
    CAST(CASE WHEN isodow(ts) - 1 < 5 AND event_id % 33 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS workingday,
    CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                         WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS weather,
    CAST((event_id * 7919) % 4100 AS DOUBLE) / 100 AS temp,
    CAST((event_id * 7919) % 4100 + (user_id * 37) % 500 AS DOUBLE) / 100 AS atemp,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS humidity,
    least(value, 57::DOUBLE) AS windspeed,
    CAST((event_id * 31) % 11 AS INTEGER) AS noise
  FROM events
), demand AS (
  SELECT *, CAST(floor(50::DOUBLE
     * (CASE season WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 1.2::DOUBLE WHEN 3 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)
     * (CASE WHEN hour(datetime) BETWEEN 7 AND 9 THEN 1.8::DOUBLE WHEN hour(datetime) BETWEEN 17 AND 19 THEN 1.6::DOUBLE
             WHEN hour(datetime) BETWEEN 10 AND 16 THEN 1.2::DOUBLE ELSE 0.4::DOUBLE END)
     * (CASE weather WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END)
     * least(greatest(1::DOUBLE - abs(temp - 25::DOUBLE) / 50::DOUBLE, 0.2::DOUBLE), 1.0::DOUBLE) * 2::DOUBLE) AS INTEGER)
     + noise AS cnt
  FROM fx
), predictions AS (
  SELECT event_id, 'rule' AS model, CAST(greatest(cnt - 5, 0) AS DOUBLE) AS y_true, CAST(cnt - noise AS DOUBLE) AS y_pred FROM demand
  UNION ALL
  SELECT event_id, 'flat', CAST(greatest(cnt - 5, 0) AS DOUBLE), 60.0::DOUBLE FROM demand
  UNION ALL
  SELECT event_id, 'hour', CAST(greatest(cnt - 5, 0) AS DOUBLE),
         CASE WHEN hour(datetime) BETWEEN 7 AND 19 THEN 85.0::DOUBLE ELSE 25.0::DOUBLE END FROM demand
), epoch_log AS (
  SELECT user_id AS job_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS epoch,
    value * 0.9::DOUBLE AS train_loss, value AS val_loss FROM events
), job_events AS (
  SELECT user_id AS job_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('view', 'click') THEN 'epoch' WHEN event_type = 'signup' THEN 'status'
         WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS event,
    props AS data FROM events
), batch_loss AS (
  SELECT l_suppkey AS job_id, l_linenumber AS epoch, l_quantity AS loss FROM lineitem
), trials AS (
  SELECT p_partkey AS trial_id, CASE WHEN p_size % 2 = 0 THEN 'mlp' ELSE 'lstm' END AS model_type,
    p_type AS hidden, (p_size % 4 + 1) / 10::DOUBLE AS dropout, CAST(32 * (1 + p_size % 3) AS INTEGER) AS batch_size,
    (p_retailprice - 900) / 100::DOUBLE AS r2, CAST(p_size AS DOUBLE) AS training_time, p_brand AS brand
  FROM part
), jobs AS (
  SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'mlp' ELSE 'lstm' END AS model_type,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
    o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 600000 END AS r2
  FROM orders
), features AS (
  SELECT event_id, datetime, cnt, season, holiday, workingday, weather, temp, atemp, humidity, windspeed,
    CAST(hour(datetime) AS FLOAT) AS hour, CAST(day(datetime) AS FLOAT) AS day,
    CAST(month(datetime) AS FLOAT) AS month, CAST(year(datetime) AS FLOAT) AS year,
    CAST(isodow(datetime) - 1 AS FLOAT) AS weekday,
    CAST(sin(2 * pi() * hour(datetime) / 24) AS FLOAT) AS hour_sin,
    CAST(cos(2 * pi() * hour(datetime) / 24) AS FLOAT) AS hour_cos,
    CAST(sin(2 * pi() * day(datetime) / 31) AS FLOAT) AS day_sin,
    CAST(cos(2 * pi() * day(datetime) / 31) AS FLOAT) AS day_cos,
    CAST(sin(2 * pi() * month(datetime) / 12) AS FLOAT) AS month_sin,
    CAST(cos(2 * pi() * month(datetime) / 12) AS FLOAT) AS month_cos,
    CAST(sin(2 * pi() * (isodow(datetime) - 1) / 7) AS FLOAT) AS weekday_sin,
    CAST(cos(2 * pi() * (isodow(datetime) - 1) / 7) AS FLOAT) AS weekday_cos,
    CAST(CASE WHEN hour(datetime) BETWEEN 7 AND 9 OR hour(datetime) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS FLOAT) AS is_rush_hour,
    CAST(CASE WHEN isodow(datetime) - 1 IN (5, 6) THEN 1 ELSE 0 END AS FLOAT) AS is_weekend,
    CAST(temp * humidity / 100 AS FLOAT) AS temp_humidity,
    CAST(temp * windspeed AS FLOAT) AS temp_windspeed
  FROM demand
), indexed AS (
  SELECT *, CAST(row_number() OVER (ORDER BY datetime, event_id) - 1 AS BIGINT) AS idx FROM demand
)
"""


def with_fixtures(sql: str) -> str:
    """Prefix a query body with the fixture CTEs (DuckDB ignores unused ones)."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        # merge a query's own CTE list into ours
        return FIXTURE_CTES.rstrip() + ",\n" + body[5:]
    return FIXTURE_CTES + body
