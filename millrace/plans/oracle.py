"""The queries of this package in the SQL of DuckDB, for comparison."""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S'"
SHOWN = "'%Y-%m-%d %H:%M:%S'"

#: The raw requests, as typed columns of text.
RAW = f"""
closes AS (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY 1),
base AS (
  SELECT o_orderkey AS k, *, CAST(o_orderdate AS DATE) AS oday, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) AS made,
    unnest(CASE WHEN o_orderkey % 89 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN closes ON o_orderkey = l_orderkey),
raw AS (
  SELECT CASE WHEN k % 91 = 0 THEN oday + 1 ELSE oday END AS partition_date, k * 2 + copy AS row_num,
    CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN '  ' ELSE ' ' || k END AS unique_key,
    CASE WHEN k % 83 = 0 THEN 'not a date' ELSE strftime(made, {ISO}) END AS created_date,
    strftime(closed + to_hours(23) + to_minutes(CAST(k % 60 AS INT)), {ISO}) AS closed_date,
    CASE WHEN k % 107 = 0 THEN NULL ELSE strftime(made + to_days(CAST(copy AS INT)), {ISO}) END AS updated_at,
    CASE WHEN k % 97 = 0 THEN NULL ELSE lower(c_mktsegment) END AS agency,
    CASE WHEN k % 13 = 0 THEN '' ELSE 'Department of ' || c_mktsegment END AS agency_name,
    CASE WHEN k % 79 = 0 THEN ' ' ELSE ' ' || replace(o_orderpriority, '-', ' - ') || '/side''s a.b' END AS complaint_type,
    CASE WHEN k % 11 = 0 THEN NULL ELSE 'status  ' || o_orderstatus END AS descriptor,
    CASE WHEN k % 71 = 0 THEN NULL WHEN k % 73 = 0 THEN 'unspecified' ELSE ' ' || lower(r_name) || ' ' END AS borough,
    CASE WHEN k % 67 = 0 THEN 'abc' WHEN k % 61 = 0 THEN '10001-22' ELSE lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS incident_zip,
    CASE WHEN copy = 1 THEN 'RE-OPENED' WHEN k % 59 = 0 THEN '' ELSE 'closed' END AS status,
    CASE WHEN k % 53 = 0 THEN '1e9' ELSE '40.' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS latitude,
    CASE WHEN k % 47 = 0 THEN '-73.6' || chr(10) ELSE '-73.' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS longitude
  FROM base)
"""


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), lambda w: upper(w[1]) || w[2:]), '')"


def clock(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN try_cast({x} AS TIMESTAMP) END"


def utc(x: str) -> str:
    return f"(({x} AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')"


def squeezed(x: str) -> str:
    return f"nullif(regexp_replace(trim({x}, ' '), '\\s+', ' ', 'g'), '')"


def boxed(x: str, low: str, high: str) -> str:
    v = f"CASE WHEN regexp_full_match({x}, '-?\\d+(\\.\\d+)?') THEN try_cast({x} AS DECIMAL(38, 12)) END"
    return f"CASE WHEN ({v}) BETWEEN {low} AND {high} THEN CAST({v} AS DOUBLE) END"


PARSED = f"""{RAW},
parsed AS (
  SELECT *, {clock('created_date')} AS created_local, {clock('closed_date')} AS closed_local FROM (
    SELECT partition_date, row_num, nullif(trim(unique_key, ' '), '') AS unique_key, created_date, closed_date, try_cast(updated_at AS TIMESTAMP) AS version,
      nullif(upper(trim(agency, ' ')), '') AS agency_code, {squeezed('complaint_type')} AS complaint_raw, nullif(trim(agency_name, ' '), '') AS agency_name,
      coalesce({title(squeezed('descriptor'))}, '') AS descriptor,
      coalesce(nullif(nullif(upper(trim(borough, ' ')), ''), 'UNSPECIFIED'), 'UNKNOWN') AS borough,
      coalesce(regexp_extract(trim(incident_zip, ' '), '^(\\d{{5}})', 1), '') AS zip, {title("nullif(trim(status, ' '), '')")} AS status,
      {boxed('latitude', '40.4', '41.0')} AS latitude, {boxed('longitude', '-74.3', '-73.6')} AS longitude
    FROM raw)),
timed AS (SELECT *, {utc('created_local')} AS created_at, {utc('closed_local')} AS closed_raw FROM parsed),
reasoned AS (
  SELECT *, CASE WHEN closed_raw >= created_at AND closed_raw <= TIMESTAMP '2000-01-01' THEN closed_raw END AS closed_at,
    created_at IS NOT NULL AND closed_raw IS NOT NULL AND NOT (closed_raw >= created_at AND closed_raw <= TIMESTAMP '2000-01-01') AS impossible_close,
    CASE WHEN unique_key IS NULL THEN 'missing unique_key' WHEN created_at IS NULL THEN 'missing or invalid created_date' WHEN agency_code IS NULL THEN 'missing agency'
      WHEN complaint_raw IS NULL THEN 'missing complaint_type' WHEN CAST(created_local AS DATE) <> partition_date THEN 'created_date outside partition' END AS reject_reason
  FROM timed),
staged AS (
  SELECT *, {title('complaint_raw')} AS complaint_type,
    (((epoch_us(closed_at) - epoch_us(created_at)) * 100 + 1800000000) // 3600000000) / 100.0 AS resolution_hours
  FROM reasoned WHERE reject_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY partition_date, unique_key ORDER BY version DESC NULLS LAST, row_num DESC) = 1)
"""

_PROFILE = """count(*) AS total, count(*) FILTER (unique_key IS NULL OR trim(unique_key, ' ') = '') AS missing_unique_key,
  count(*) FILTER (created_date IS NULL OR trim(created_date, ' ') = '') AS missing_created_date, count(*) FILTER (agency IS NULL OR trim(agency, ' ') = '') AS missing_agency,
  count(*) FILTER (complaint_type IS NULL OR trim(complaint_type, ' ') = '') AS missing_complaint_type,
  count(*) FILTER (unique_key IS NULL OR trim(unique_key, ' ') = '' OR created_date IS NULL OR trim(created_date, ' ') = '' OR agency IS NULL OR trim(agency, ' ') = ''
    OR complaint_type IS NULL OR trim(complaint_type, ' ') = '') AS missing_any,
  count(*) FILTER (coalesce(upper(trim(borough, ' ')), '') IN ('', 'UNSPECIFIED')) AS missing_borough, count(*) FILTER (coalesce(NOT regexp_matches(trim(incident_zip, ' '), '^\\d{5}'), true)) AS invalid_zip,
  count(*) - count(DISTINCT unique_key) AS duplicates"""


def _pct(x: str) -> str:
    return f"CASE WHEN total = 0 THEN 100.0::DOUBLE ELSE floor({x} * 100.0::DOUBLE / total * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END"


_GATE_CHECKS = [("row_count", "total BETWEEN 100 AND 100000")] + [(f"missing_{c}", f"{_pct(f'missing_{c}')} <= 1.2") for c in ("unique_key", "created_date", "agency", "complaint_type")] + [("missing_borough", f"{_pct('missing_borough')} <= 10"), ("invalid_zip", f"{_pct('invalid_zip')} <= 25"), ("duplicates", f"{_pct('duplicates')} <= 5")]
_FAILURES = "concat_ws('; ', " + ", ".join(f"CASE WHEN NOT ({ok}) THEN '{n}' END" for n, ok in _GATE_CHECKS) + ")"

_DIGEST = f"md5(concat_ws('|', unique_key, coalesce(status, ''), coalesce(strftime(closed_at, {SHOWN}), ''), agency_code, complaint_type, borough, zip))"
_LINE = _DIGEST[4:-1]


def _key(x: str) -> str:
    return f"CAST(strftime({x}, '%Y%m%d') AS INT)"


LOG = """
log AS (
  SELECT user_id AS workflow_id, event_id,
    CASE WHEN event_id % 97 = 0 THEN 'WorkflowCompleted' WHEN event_type = 'view' THEN 'TaskQueued' WHEN event_type = 'click' THEN 'TaskStarted' WHEN event_type = 'purchase' THEN 'TaskSucceeded'
      WHEN event_type = 'error' THEN 'TaskFailed' ELSE (['TaskDeadLettered', 'TaskSkipped', 'WorkflowStarted'])[1 + event_id % 3] END AS event_type,
    't' || (event_id % 4) AS task_id, CAST(event_id % 3 + 1 AS INT) AS attempt, 'w' || (event_id % 6) AS worker_id,
    CASE WHEN event_id % 4 = 0 THEN 'lease expired (worker w' || (event_id % 6) || ')' WHEN event_id % 4 = 1 THEN 'timed out while waiting for the upstream service, request ' || event_id ELSE 'connection refused' END AS error,
    ts + INTERVAL 30 SECONDS AS lease_at, ts + INTERVAL 500 MILLISECONDS AS retry_at, 'out-' || event_id AS output, ts AS created_at,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
  FROM events)
"""
RUNS = f"""{LOG},
runs AS (
  SELECT *, 'wf' || (workflow_id % 7) AS name, CASE WHEN workflow_id % 11 <> 0 THEN 'u' || (workflow_id % 5) END AS owner FROM (
    SELECT workflow_id, CASE arg_max(event_type, sequence) FILTER (event_type LIKE 'Workflow%') WHEN 'WorkflowStarted' THEN 'RUNNING' WHEN 'WorkflowCompleted' THEN 'COMPLETED' END AS status,
      count(*) AS version, min(created_at) AS created_at, max(created_at) AS updated_at, max(created_at) FILTER (event_type = 'WorkflowCompleted') AS finished_at
    FROM log GROUP BY 1))
"""
_STATUS = "CASE {x} WHEN 'TaskQueued' THEN 'QUEUED' WHEN 'TaskStarted' THEN 'RUNNING' WHEN 'TaskSucceeded' THEN 'SUCCEEDED' WHEN 'TaskFailed' THEN 'RETRY_WAIT' WHEN 'TaskDeadLettered' THEN 'DEAD_LETTERED' WHEN 'TaskSkipped' THEN 'SKIPPED' END"
_LAST = "last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY sequence DESC) = 1)"

_LATENCY = f"""{LOG},
pairs AS (SELECT workflow_id, task_id, attempt, epoch_us(max(created_at) FILTER (event_type = 'TaskQueued')) AS a, epoch_us(min(created_at) FILTER (event_type = 'TaskSucceeded')) AS b
  FROM log WHERE event_type IN ('TaskQueued', 'TaskSucceeded') GROUP BY ALL),
lat AS (SELECT attempt, (b - a) / 1000 AS ms FROM pairs WHERE b >= a)"""

VERSIONS = """
old AS (SELECT o_orderkey AS key, o_orderstatus AS status, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS version FROM orders WHERE o_orderkey % 7 <> 0),
new AS (SELECT o_orderkey AS key, lower(o_orderstatus) AS status, CASE WHEN o_orderkey % 12 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) - 1 END AS version FROM orders WHERE o_orderkey % 2 = 0),
merged AS (
  SELECT key, CASE WHEN action IN ('insert', 'update') THEN n_status ELSE o_status END AS status, CASE WHEN action IN ('insert', 'update') THEN n_version ELSE o_version END AS version, action FROM (
    SELECT coalesce(old.key, new.key) AS key, old.status AS o_status, old.version AS o_version, new.status AS n_status, new.version AS n_version,
      CASE WHEN old.key IS NULL THEN 'insert' WHEN new.key IS NULL THEN 'keep' WHEN new.version > old.version OR (old.version IS NULL AND new.version IS NOT NULL) THEN 'update' ELSE 'unchanged' END AS action
    FROM old FULL JOIN new ON old.key = new.key))
"""

_TASKS = """
placed AS (SELECT c_custkey // 20000 * 100 + c_nationkey AS workflow_id, c_custkey AS k, row_number() OVER (PARTITION BY c_custkey // 20000 * 100 + c_nationkey ORDER BY c_custkey) - 1 AS place, 'c' || c_custkey AS task_id FROM customer),
half AS (SELECT p.workflow_id, p.place, p.task_id, q.task_id AS dep FROM placed p JOIN placed q ON p.workflow_id = q.workflow_id AND q.place = (p.place - 1) // 2 AND p.place > 0),
up AS (SELECT p.workflow_id, p.place, p.task_id, q.task_id AS dep FROM placed p JOIN placed q ON p.workflow_id = q.workflow_id AND q.place = p.place - 3 AND p.place % 5 = 0),
edges AS (SELECT workflow_id, task_id, dep FROM half UNION SELECT workflow_id, task_id, dep FROM up)
"""
_ERRORS = f"""{_TASKS},
wrong AS (
  SELECT workflow_id, 0 AS a, place + 1000000 AS b, 0 AS c, 'duplicate task id ''' || task_id || '''' AS error FROM placed WHERE k % 43 = 0
  UNION ALL SELECT workflow_id, 1, place + x, 8, 'task ''' || task_id || ''' depends on unknown task ''x' || k || '''' FROM placed, (SELECT unnest([0, 1000000]) AS x) WHERE k % 37 = 0 AND (x = 0 OR k % 43 = 0)
  UNION ALL SELECT workflow_id, 1, place + x, 9, 'task ''' || task_id || ''' depends on itself' FROM placed, (SELECT unnest([0, 1000000]) AS x) WHERE k % 41 = 0 AND (x = 0 OR k % 43 = 0))"""

_SPANS = """
lines AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, max(l_shipdate) AS d FROM lineitem GROUP BY 1, 2),
spans AS (SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS span_id, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber // 2 AS BIGINT) END AS parent_id, 's' || (s % 3) AS service, epoch_us(d) * 1000 AS start_ns FROM lines)
"""



def _load_report(number: str, inserted: str, updated: str, unchanged: str) -> str:
    """The report of a run over all days: facts are the latest version of each key over all days."""
    return f"""WITH {PARSED}, span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) + 1 AS b FROM orders),
latest AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY version DESC NULLS LAST, partition_date DESC, row_num DESC) = 1),
counts AS (SELECT (SELECT count(*) FROM raw) AS extracted, (SELECT count(*) FROM reasoned WHERE reject_reason IS NOT NULL) AS rejected, (SELECT count(*) FROM staged) AS accepted, (SELECT count(*) FROM latest) AS n,
  (SELECT count(*) FROM (SELECT DISTINCT CAST(created_local AS DATE), borough, complaint_type FROM latest)) AS aggregates)
SELECT 'run-{number}' AS run_id, b - a + 1 AS partitions, extracted AS rows_extracted, rejected AS rows_rejected, extracted - rejected - accepted AS duplicates_removed, accepted AS rows_accepted,
  CAST({inserted} AS BIGINT) AS rows_inserted, CAST({updated} AS BIGINT) AS rows_updated, CAST({unchanged} AS BIGINT) AS rows_unchanged, n AS fact_rows_in_range, aggregates AS aggregate_rows, CAST(b AS VARCHAR) AS watermark_after
FROM counts, span"""


def _reasons(most: float) -> str:
    texts = [f"CASE WHEN {_pct(f'missing_{c}')} > {most} THEN 'missing_{c}_pct=' || {_pct(f'missing_{c}')} || '% > {most}%' END" for c in ("unique_key", "created_date", "agency", "complaint_type")]
    return f"concat_ws('; ', {', '.join(texts)})"


ORACLE: dict[str, str] = {
    "dq_profile": f"WITH {RAW} SELECT {_PROFILE} FROM raw",
    "dq_profile_by_month": f"WITH {RAW} SELECT strftime(partition_date, '%Y-%m') AS month, {_PROFILE} FROM raw GROUP BY 1",
    "dq_gate_status": f"WITH {RAW}, p AS (SELECT strftime(partition_date, '%Y-%m') AS month, {_PROFILE} FROM raw GROUP BY 1), g AS (SELECT *, {_FAILURES} AS failures FROM p) SELECT month, total, {_pct('missing_agency')} AS missing_agency_pct, {_pct('invalid_zip')} AS invalid_zip_pct, {_pct('duplicates')} AS duplicates_pct, failures, failures = '' AS passed FROM g",
    "dq_volume_vs_median": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows FROM events GROUP BY 1),
h AS (SELECT d.day, d.n_rows, count(p.n_rows) AS history, quantile_cont(p.n_rows, 0.5) AS median FROM d LEFT JOIN d p ON p.day BETWEEN d.day - 14 AND d.day - 1 GROUP BY ALL),
r AS (SELECT *, CASE WHEN history >= 5 AND median > 0 THEN floor(n_rows / median * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS ratio FROM h)
SELECT day, n_rows, history, CAST(median AS DOUBLE) AS median, ratio, CASE WHEN history < 5 THEN 'skipped' WHEN ratio >= 0.5 THEN 'passed' ELSE 'failed' END AS status FROM r""",
    "reject_reasons": f"WITH {PARSED} SELECT reject_reason AS reason, count(*) AS n, min(row_num) AS first_row FROM reasoned WHERE reject_reason IS NOT NULL GROUP BY 1",
    "rejected_rows": f"WITH {PARSED} SELECT 'run-1' AS run_id, partition_date, row_num, unique_key, reject_reason AS reason FROM reasoned WHERE reject_reason IS NOT NULL",
    "accepted_rows": f"WITH {PARSED} SELECT partition_date, row_num, unique_key FROM reasoned WHERE reject_reason IS NULL",
    "clean_columns": f"WITH {PARSED} SELECT unique_key, agency_code, agency_name, complaint_type, descriptor, borough, zip, status, latitude, longitude FROM staged",
    "local_to_utc_days": f"WITH {PARSED} SELECT unique_key, strftime(created_at, {SHOWN}) AS created_utc, strftime(closed_at, {SHOWN}) AS closed_utc, partition_date FROM staged",
    "local_to_utc_clock_changes": f"WITH t AS (SELECT d + to_minutes(CAST(n * 30 AS INT)) AS local FROM (SELECT unnest([TIMESTAMP '2026-03-08', TIMESTAMP '2026-11-01']) AS d), range(12) r(n)) SELECT strftime(local, {SHOWN}) AS local, strftime({utc('local')}, {SHOWN}) AS utc FROM t",
    "resolution_hours": f"WITH {PARSED} SELECT unique_key, CAST(resolution_hours AS DOUBLE) AS resolution_hours FROM staged",
    "transform_stats": f"WITH {PARSED}, i AS (SELECT partition_date, count(*) AS rows_in, count(reject_reason) AS rows_rejected, count(*) FILTER (impossible_close) AS impossible_closes FROM reasoned GROUP BY 1), o AS (SELECT partition_date, count(*) AS n FROM staged GROUP BY 1) SELECT partition_date, rows_in, rows_rejected, impossible_closes, coalesce(n, 0) AS rows_out, rows_in - rows_rejected - coalesce(n, 0) AS duplicates_removed FROM i LEFT JOIN o USING (partition_date)",
    "dedup_latest_version": "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1",
    "dim_date": f"WITH {PARSED}, d AS (SELECT CAST(created_local AS DATE) AS f FROM staged UNION SELECT CAST(closed_local AS DATE) FROM staged WHERE closed_at IS NOT NULL) SELECT {_key('f')} AS date_key, f AS full_date, CAST(year(f) AS INT) AS year, CAST(month(f) AS INT) AS month, CAST(day(f) AS INT) AS day, CAST(isodow(f) AS INT) AS day_of_week, isodow(f) >= 6 AS is_weekend FROM d",
    "dim_agency_best_name": f"WITH {PARSED} SELECT agency_code, min(agency_name) AS agency_name FROM staged GROUP BY 1",
    "dim_location": f"WITH {PARSED} SELECT CAST(row_number() OVER (ORDER BY borough, zip) AS INT) AS location_key, borough, zip FROM (SELECT DISTINCT borough, zip FROM staged)",
    "fact_star_join": f"WITH {PARSED} SELECT unique_key, {_key('created_local')} AS created_date_key, CASE WHEN closed_at IS NOT NULL THEN {_key('closed_local')} END AS closed_date_key, agency_code, complaint_type, descriptor, borough, zip, status, CAST(resolution_hours AS DOUBLE) AS resolution_hours FROM staged",
    "agg_daily": f"WITH {PARSED} SELECT {_key('created_local')} AS date_key, borough, complaint_type, count(*) AS requests, count(closed_at) AS closed, CASE WHEN count(closed_at) > 0 THEN ((2 * sum(CAST(round(resolution_hours * 100) AS BIGINT)) + count(closed_at)) // (2 * count(closed_at))) / 100.0::DOUBLE END AS avg_resolution_hours FROM staged GROUP BY 1, 2, 3",
    "fact_checksum": f"WITH {PARSED}, d AS (SELECT {_key('created_local')} AS k, md5(string_agg({_LINE}, ',' ORDER BY unique_key, {_LINE})) AS h FROM staged GROUP BY 1) SELECT md5(coalesce(string_agg(k || ':' || h, ',' ORDER BY k), '')) AS fact_checksum FROM d",
    "fact_checksum_by_day": f"WITH {PARSED}, d AS (SELECT {_key('created_local')} AS created_date_key, {_DIGEST} AS h FROM staged) SELECT created_date_key, count(*) AS facts, CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR) || '-' || CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR) AS day_checksum FROM d GROUP BY 1",
    "merge_newest_wins": f"WITH {VERSIONS} SELECT key, status, version, action FROM merged",
    "merge_outcome_counts": f"WITH {VERSIONS} SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged FROM merged",
    "merge_rerun_is_noop": f"WITH {VERSIONS} SELECT CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated, count(*) AS unchanged FROM new",
    "upsert_run_status": f"WITH {VERSIONS} SELECT coalesce(old.key, new.key) AS key, CASE WHEN new.key IS NOT NULL THEN new.status ELSE old.status END AS status, CASE WHEN old.key IS NOT NULL THEN old.version ELSE new.version END AS version FROM old FULL JOIN new ON old.key = new.key",
    "insert_absent_keys": f"WITH {VERSIONS} SELECT * FROM old UNION ALL SELECT * FROM new WHERE key NOT IN (SELECT key FROM old)",
    "dimension_name_updates": """WITH o AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 9 <> 0 THEN c_name || CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END END AS name FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.code, n.code) AS code, coalesce(n.name, o.name) AS name, CASE WHEN o.code IS NULL THEN 'insert' WHEN n.name IS NOT NULL AND n.name IS DISTINCT FROM o.name THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.code = n.code""",
    "replace_date_range": f"WITH d AS (SELECT {_key('o_orderdate')} AS date_key, count(*) AS n FROM orders GROUP BY 1) SELECT * FROM d WHERE date_key NOT BETWEEN 19960101 AND 19961231 UNION ALL SELECT date_key, n * 10 FROM d WHERE date_key % 3 <> 0 AND date_key BETWEEN 19960101 AND 19961231",
    "append_conflicts": f"WITH {LOG} SELECT workflow_id, sequence, event_type FROM log WHERE event_id % 2 = 0",
    "numbered_appends": "WITH v AS (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN max(event_id) % 100 ELSE 0 END AS v FROM events GROUP BY 1) SELECT user_id AS workflow_id, event_id, v + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events JOIN v USING (user_id)",
    "watermark_advance_matrix": """SELECT name, CAST(current AS DATE) AS current, CAST(a AS DATE) AS start_day, CAST(b AS DATE) AS end_day,
CASE WHEN current IS NULL OR (CAST(current AS DATE) >= CAST(a AS DATE) - 1 AND CAST(b AS DATE) > CAST(current AS DATE)) THEN CAST(b AS DATE) ELSE CAST(current AS DATE) END AS after
FROM (VALUES ('none', NULL, '2024-01-01', '2024-01-31'), ('contiguous', '2024-01-31', '2024-02-01', '2024-02-10'), ('overlap', '2024-01-31', '2024-01-15', '2024-02-10'), ('gap', '2024-01-31', '2024-02-02', '2024-02-10'), ('backwards', '2024-01-31', '2024-01-01', '2024-01-10'), ('equal', '2024-01-31', '2024-01-31', '2024-01-31')) t(name, current, a, b)""",
    "json_unnest_ordinal": "SELECT event_id // 100 AS page_no, (event_id // 100) * 100 + row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS row_num, CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events",
    "drop_key_fault": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "props_profile": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2",
    "events_join_runs_status_counts": f"WITH {RUNS}, c AS (SELECT name, coalesce(status, 'NONE') AS status, count(*) AS n FROM runs GROUP BY 1, 2) SELECT name, string_agg(status || '=' || n, ' ' ORDER BY status) AS histogram FROM c GROUP BY 1",
    "event_type_counts": f"WITH {RUNS} SELECT name, event_type, count(*) AS n FROM log JOIN runs USING (workflow_id) GROUP BY 1, 2",
    "duplicate_successes": f"WITH {LOG} SELECT workflow_id, task_id, count(*) AS successes FROM log WHERE event_type = 'TaskSucceeded' GROUP BY 1, 2 HAVING count(*) > 1",
    "rerun_counts": f"WITH {LOG} SELECT workflow_id, count(*) FILTER (event_type = 'TaskFailed') AS failures, count(*) FILTER (event_type = 'TaskStarted' AND attempt > 1) AS reruns, count(*) FILTER (event_type = 'TaskFailed' AND error LIKE 'lease expired%') AS lease_expiries FROM log GROUP BY 1",
    "retry_reasons": f"WITH {LOG} SELECT left(error, 45) AS reason, count(*) AS n FROM log WHERE event_type = 'TaskFailed' GROUP BY 1",
    "max_stall_per_key": f"WITH {LOG}, g AS (SELECT workflow_id, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY workflow_id ORDER BY sequence) AS gap FROM log) SELECT workflow_id, max(gap) / 1000 AS max_stall_ms FROM g GROUP BY 1",
    "last_event_per_key": f"WITH {LOG}, {_LAST} SELECT workflow_id, sequence, event_type, task_id, attempt FROM last",
    "stuck_workflows": f"WITH {LOG}, {_LAST} SELECT workflow_id, sequence, event_type FROM last WHERE event_type <> 'WorkflowCompleted' ORDER BY workflow_id LIMIT 10",
    "stuck_by_type_and_attempt": f"WITH {LOG}, {_LAST} SELECT event_type, attempt, count(*) AS n FROM last WHERE event_type <> 'WorkflowCompleted' GROUP BY 1, 2",
    "run_throughput": f"WITH {RUNS}, s AS (SELECT name, (epoch_us(max(updated_at)) - epoch_us(min(created_at))) / 1000000 AS elapsed_s FROM runs GROUP BY 1), d AS (SELECT name, count(*) AS tasks FROM log JOIN runs USING (workflow_id) WHERE log.event_type = 'TaskSucceeded' GROUP BY 1) SELECT name, elapsed_s, tasks, CASE WHEN elapsed_s > 0 THEN tasks / elapsed_s END AS tasks_per_s FROM s JOIN d USING (name)",
    "latency_quantiles": f"WITH {_LATENCY} SELECT attempt, count(*) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99 FROM lat GROUP BY 1",
    "latency_buckets": f"""WITH {_LATENCY}, b AS (SELECT len(list_filter([1e6, 1e7, 5e7, 1e8, 5e8, 1e9, 5e9], lambda x: ms > x)) AS bucket, count(*) AS n FROM lat GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM b),
v AS (SELECT bucket, CASE WHEN bucket >= 7 THEN 5e9 ELSE ([0.0, 1e6, 1e7, 5e7, 1e8, 5e8, 1e9, 5e9])[bucket + 1] + (([1e6, 1e7, 5e7, 1e8, 5e8, 1e9, 5e9, 5e9])[bucket + 1] - ([0.0, 1e6, 1e7, 5e7, 1e8, 5e8, 1e9, 5e9])[bucket + 1]) * (total * 0.95::DOUBLE - (upto - n)) / n END AS q FROM c WHERE upto >= total * 0.95::DOUBLE)
SELECT CAST(arg_min(q, bucket) AS DOUBLE) AS quantile FROM v""",
    "peak_rate_sliding": """WITH s AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(CAST(15 * k AS INT)) AS start FROM events, range(4) r(k)),
c AS (SELECT event_type, start, count(*) AS n FROM s GROUP BY 1, 2)
SELECT event_type, max(n) AS peak, min(start) FILTER (n = m) AS peak_start FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS m FROM c) GROUP BY 1""",
    "active_workflows": f"WITH {LOG}, m AS (SELECT *, CASE event_type WHEN 'WorkflowStarted' THEN 1 WHEN 'WorkflowCompleted' THEN -1 END AS step FROM log) SELECT created_at, workflow_id, sequence, CAST(sum(step) OVER (ORDER BY created_at, workflow_id, sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM m WHERE step IS NOT NULL",
    "list_page": f"WITH {RUNS} SELECT workflow_id, name, created_at, (SELECT count(*) FROM runs) AS total_elements, CAST(ceil((SELECT count(*) FROM runs) / 20) AS BIGINT) AS total_pages FROM runs ORDER BY created_at DESC, workflow_id LIMIT 20 OFFSET 20",
    "visible_rows": f"WITH {RUNS} SELECT workflow_id, name, owner, version FROM runs WHERE owner = 'u3'",
    "run_view": f"WITH {RUNS} SELECT * FROM runs",
    "task_state_fold": f"""WITH {LOG}, t AS (SELECT * FROM log WHERE event_type LIKE 'Task%'),
f AS (SELECT workflow_id, task_id, arg_max(event_type, sequence) AS last_type, arg_max(attempt, sequence) FILTER (event_type = 'TaskQueued') AS queued_attempt, arg_max(created_at, sequence) FILTER (event_type = 'TaskQueued') AS queued_at,
  arg_max(worker_id, sequence) FILTER (event_type = 'TaskStarted') AS worker, arg_max(lease_at, sequence) FILTER (event_type = 'TaskStarted') AS lease, arg_max(retry_at, sequence) FILTER (event_type = 'TaskFailed') AS retry,
  arg_max(error, sequence) FILTER (event_type IN ('TaskFailed', 'TaskDeadLettered', 'TaskSkipped')) AS last_error, arg_max(output, sequence) FILTER (event_type = 'TaskSucceeded') AS out,
  max(sequence) FILTER (event_type = 'TaskQueued') AS qs, max(sequence) FILTER (event_type = 'TaskStarted') AS ss, count(*) AS n_events FROM t GROUP BY 1, 2)
SELECT workflow_id, task_id, {_STATUS.format(x='last_type')} AS status, coalesce(queued_attempt, 0) AS attempt, queued_at, CASE WHEN last_type IN ('TaskStarted', 'TaskSucceeded') AND ss > coalesce(qs, -1) THEN worker END AS worker_id,
  CASE WHEN last_type = 'TaskStarted' THEN lease END AS lease_at, CASE WHEN last_type = 'TaskFailed' THEN retry END AS retry_at, last_error, CASE WHEN last_type = 'TaskSucceeded' THEN out END AS output, n_events FROM f""",
    "illegal_transitions": f"""WITH {LOG}, t AS (SELECT *, coalesce({_STATUS.format(x='lag(event_type) OVER w')}, 'PENDING') AS from_status,
  coalesce(last_value(CASE WHEN event_type = 'TaskQueued' THEN attempt END IGNORE NULLS) OVER (PARTITION BY workflow_id, task_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur
  FROM log WHERE event_type LIKE 'Task%' WINDOW w AS (PARTITION BY workflow_id, task_id ORDER BY sequence)),
r AS (SELECT *, CASE WHEN NOT CASE event_type WHEN 'TaskQueued' THEN from_status IN ('PENDING', 'RETRY_WAIT') WHEN 'TaskStarted' THEN from_status = 'QUEUED' WHEN 'TaskSkipped' THEN from_status = 'PENDING' ELSE from_status IN ('QUEUED', 'RUNNING') END THEN 'status'
  WHEN NOT CASE event_type WHEN 'TaskQueued' THEN attempt = cur + 1 WHEN 'TaskSkipped' THEN true ELSE attempt = cur END THEN 'attempt' END AS why FROM t)
SELECT workflow_id, sequence, task_id, event_type, from_status, why FROM r WHERE why IS NOT NULL""",
    "events_after_end": f"WITH {LOG}, e AS (SELECT workflow_id, min(sequence) AS s FROM log WHERE event_type = 'WorkflowCompleted' GROUP BY 1) SELECT workflow_id, sequence, event_type FROM log JOIN e USING (workflow_id) WHERE sequence > s",
    "ignored_kinds": "SELECT (['stale_attempt', 'duplicate_start', 'workflow_not_running', 'workflow_not_running', 'timer_early', 'timer_early', 'duplicate_or_late', 'other'])[1 + event_id % 8] AS kind, count(*) AS n FROM events GROUP BY 1",
    "backoff_schedule": "SELECT CAST(a AS INT) AS attempt, CAST(floor(least(500 * pow(2.0, a - 1), 30000)) AS BIGINT) AS base_ms, CAST(floor(floor(least(500 * pow(2.0, a - 1), 30000)) * 0.5) AS BIGINT) AS jittered_ms FROM range(1, 21) t(a)",
    "idempotency_ids": "WITH h AS (SELECT c_custkey, md5('owner:' || c_name) AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[1 + ('0x' || substr(h, 17, 1))::INT % 4] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS run_id FROM h",
    "dag_structure_errors": f"WITH {_ERRORS} SELECT workflow_id, CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY a, b, c) AS INT) AS rank, error FROM wrong",
    "dag_unknown_deps": f"WITH {_ERRORS} SELECT workflow_id, error FROM wrong WHERE contains(error, 'unknown')",
    "dag_duplicates": f"WITH {_ERRORS} SELECT workflow_id, error FROM wrong WHERE starts_with(error, 'duplicate')",
    "dag_roots": f"WITH {_TASKS} SELECT workflow_id, task_id FROM placed WHERE (workflow_id, task_id) NOT IN (SELECT (workflow_id, task_id) FROM edges)",
    "dag_indegree": f"WITH {_TASKS}, i AS (SELECT workflow_id, task_id, count(*) AS n FROM edges GROUP BY 1, 2), o AS (SELECT workflow_id, dep AS task_id, count(*) AS n FROM edges GROUP BY 1, 2) SELECT p.workflow_id, p.task_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM placed p LEFT JOIN i USING (workflow_id, task_id) LEFT JOIN o USING (workflow_id, task_id)",
    "dag_ready": f"WITH {_TASKS}, s AS (SELECT workflow_id, task_id, CASE WHEN place % 4 <> 3 THEN 'SUCCEEDED' ELSE 'PENDING' END AS status FROM placed WHERE place < 12), u AS (SELECT e.workflow_id, e.task_id FROM edges e LEFT JOIN s ON s.workflow_id = e.workflow_id AND s.task_id = e.dep AND s.status = 'SUCCEEDED' WHERE s.status IS NULL) SELECT workflow_id, task_id FROM placed p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.workflow_id = p.workflow_id AND u.task_id = p.task_id) AND NOT EXISTS (SELECT 1 FROM s WHERE s.workflow_id = p.workflow_id AND s.task_id = p.task_id AND status <> 'PENDING')",
    "dag_levels": f"WITH RECURSIVE {_TASKS}, paths AS (SELECT workflow_id, task_id, 0 AS level FROM placed WHERE place = 0 UNION SELECT e.workflow_id, e.task_id, level + 1 FROM paths p JOIN edges e ON e.workflow_id = p.workflow_id AND e.dep = p.task_id) SELECT workflow_id, task_id, max(level) AS level FROM paths GROUP BY 1, 2",
    "dag_downstream": f"WITH RECURSIVE {_TASKS}, reach AS (SELECT p.workflow_id, p.task_id, e.task_id AS reached FROM placed p JOIN edges e ON e.workflow_id = p.workflow_id AND e.dep = p.task_id UNION SELECT r.workflow_id, r.task_id, e.task_id FROM reach r JOIN edges e ON e.workflow_id = r.workflow_id AND e.dep = r.reached) SELECT * FROM reach",
    "span_tree": f"WITH RECURSIVE {_SPANS}, kept AS (SELECT * FROM spans WHERE NOT (span_id = 2 AND trace_id % 5 = 0)), tree AS (SELECT trace_id, span_id, 0 AS depth FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept q WHERE q.trace_id = k.trace_id AND q.span_id = k.parent_id) UNION ALL SELECT k.trace_id, k.span_id, depth + 1 FROM tree t JOIN kept k ON k.trace_id = t.trace_id AND k.parent_id = t.span_id) SELECT t.trace_id, t.span_id, depth, (k.start_ns - min(k.start_ns) OVER (PARTITION BY t.trace_id)) / 1000000 AS start_ms FROM tree t JOIN kept k USING (trace_id, span_id)",
    "fullest_trace": f"WITH {_SPANS} SELECT trace_id, count(DISTINCT service) AS services, count(*) AS spans FROM spans GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1",
    "dag_orders": f"""WITH RECURSIVE {_TASKS}, paths AS (SELECT workflow_id, task_id, 0 AS level FROM placed WHERE place = 0 UNION SELECT e.workflow_id, e.task_id, level + 1 FROM paths p JOIN edges e ON e.workflow_id = p.workflow_id AND e.dep = p.task_id),
lv AS (SELECT p.workflow_id, p.task_id, p.place, max(level) AS level FROM paths JOIN placed p USING (workflow_id, task_id) GROUP BY ALL),
keyed AS (SELECT workflow_id, task_id, level, [place] AS way FROM lv WHERE level = 0
  UNION ALL SELECT l.workflow_id, l.task_id, l.level, list_append(max(k.way), any_value(l.place)) FROM keyed k JOIN edges e ON e.workflow_id = k.workflow_id AND e.dep = k.task_id JOIN lv l ON l.workflow_id = e.workflow_id AND l.task_id = e.task_id AND l.level = k.level + 1 GROUP BY l.workflow_id, l.task_id, l.level)
SELECT workflow_id, row_number() OVER (PARTITION BY workflow_id ORDER BY level, way) - 1 AS position, task_id FROM keyed""",
    "dag_cycle_path": f"WITH {_TASKS}, way AS (SELECT unnest([0, 1, 2, 3]) AS position, unnest([0, 4, 1, 0]) AS place) SELECT workflow_id, CAST(position AS BIGINT) AS position, task_id FROM way JOIN placed USING (place) WHERE workflow_id IN (SELECT workflow_id FROM placed WHERE place = 4)",
    "exported_spans": "WITH lines AS (SELECT l_orderkey AS t, l_linenumber AS n, min(l_suppkey) AS s, epoch_us(max(l_shipdate)) * 1000 AS ns FROM lineitem GROUP BY 1, 2) SELECT 's' || (s % 3) AS service, CAST(t AS VARCHAR) AS trace_id, CAST(n AS VARCHAR) AS span_id, CASE WHEN n > 1 THEN CAST(n // 2 AS VARCHAR) END AS parent_id, 'op' || n AS name, ns AS start_ns, ns + n * 1000 AS end_ns FROM lines",
    "events_before_start": f"WITH {LOG}, f AS (SELECT workflow_id, min(sequence) FILTER (event_type = 'WorkflowStarted') AS s FROM log GROUP BY 1) SELECT workflow_id, sequence, event_type FROM log JOIN f USING (workflow_id) WHERE s IS NULL OR sequence < s",
    "workflow_progress": f"WITH {LOG}, t AS (SELECT workflow_id, task_id, {_STATUS.format(x='arg_max(event_type, sequence)')} AS status FROM log WHERE event_type LIKE 'Task%' GROUP BY 1, 2) SELECT workflow_id, bool_and(status IN ('SUCCEEDED', 'DEAD_LETTERED', 'SKIPPED')) AS all_terminal, bool_or(status = 'DEAD_LETTERED') AS any_dead_lettered, coalesce(string_agg(task_id, ',' ORDER BY task_id) FILTER (status = 'SUCCEEDED'), '') AS succeeded FROM t GROUP BY 1",
    "run_events": f"WITH {LOG} SELECT workflow_id, sequence, event_type, task_id FROM log WHERE workflow_id = 7",
    "run_tasks": f"WITH {LOG}, d AS (SELECT 't' || n AS task_id FROM range(6) r(n) WHERE EXISTS (SELECT 1 FROM log WHERE workflow_id = 7)), t AS (SELECT task_id, {_STATUS.format(x='arg_max(event_type, sequence)')} AS status, arg_max(attempt, sequence) FILTER (event_type = 'TaskQueued') AS attempt, count(*) AS n FROM log WHERE event_type LIKE 'Task%' AND workflow_id = 7 GROUP BY 1) SELECT CAST(7 AS BIGINT) AS workflow_id, task_id, coalesce(status, 'PENDING') AS status, coalesce(attempt, 0) AS attempt, coalesce(n, 0) AS n_events FROM d LEFT JOIN t USING (task_id)",
    "list_page_by_status": f"WITH {RUNS}, r AS (SELECT * FROM runs WHERE owner = 'u3' AND status = 'COMPLETED') SELECT workflow_id, owner, status, (SELECT count(*) FROM r) AS total_elements, CAST(ceil((SELECT count(*) FROM r) / 5) AS BIGINT) AS total_pages FROM r ORDER BY created_at DESC, workflow_id LIMIT 5",
    "event_rates": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS increase, count(*) / 3600 AS per_second FROM events GROUP BY 1, 2",
    "greatest_rates": """WITH s AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(CAST(5 * k AS INT)) AS start FROM events, range(2) r(k)), c AS (SELECT event_type, start, count(*) / 600 AS rate FROM s GROUP BY 1, 2)
SELECT event_type, CAST(date_trunc('day', start) AS TIMESTAMP) AS start, max(rate) AS greatest FROM c GROUP BY 1, 2""",
    "json_lines_results": "SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), range(2)",
    "poison_records": "SELECT CASE WHEN event_id % 10 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 10 = 0 THEN 'broken ' || event_id END AS poison FROM events",
    "key_partitions": """WITH b AS (SELECT c_custkey, list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, CAST(i AS INT), 1)) AS HUGEINT)) AS b FROM customer),
k AS (SELECT c_custkey, b, list_transform(range(0, len(b) // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS words FROM b),
m AS (SELECT c_custkey, b, list_transform(list_transform(words, lambda x: (x * 1540483477) % 4294967296), lambda x: (xor(x, x // 16777216) * 1540483477) % 4294967296) AS words FROM k),
h AS (SELECT c_custkey, b, list_reduce(list_prepend(xor(2538058380::HUGEINT, len(b)::HUGEINT), words), lambda a, x: xor((a * 1540483477) % 4294967296, x)) AS h FROM m),
t AS (SELECT c_custkey, CASE len(b) % 4 WHEN 0 THEN h ELSE (xor(h, b[len(b) // 4 * 4 + 1] + CASE WHEN len(b) % 4 > 1 THEN b[len(b) // 4 * 4 + 2] * 256 ELSE 0 END + CASE WHEN len(b) % 4 > 2 THEN b[len(b) // 4 * 4 + 3] * 65536 ELSE 0 END) * 1540483477) % 4294967296 END AS h FROM h),
u AS (SELECT c_custkey, (xor(h, h // 8192) * 1540483477) % 4294967296 AS h FROM t)
SELECT c_custkey, CAST((xor(h, h // 32768) % 2147483648) % 12 AS INT) AS partition FROM u""",
    "load_backfill_report": _load_report("1", "n", "0", "accepted - n"),
    "load_rerun_is_noop": _load_report("2", "0", "0", "accepted").replace("AS watermark_after", "AS watermark_after, true AS same_checksum"),
    "load_failed_days": f"WITH {RAW}, p AS (SELECT partition_date, {_PROFILE} FROM raw GROUP BY 1), r AS (SELECT CAST(unnest(range(min(o_orderdate), max(o_orderdate) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS partition_date FROM orders), d AS (SELECT r.partition_date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total', 'missing_unique_key', 'missing_created_date', 'missing_agency', 'missing_complaint_type'))} FROM r LEFT JOIN p USING (partition_date)), c AS (SELECT partition_date, {_reasons(10.0)} AS reasons FROM d) SELECT 'data quality gate failed for ' || partition_date || ': ' || reasons AS failure, CAST(NULL AS VARCHAR) AS watermark_after FROM c WHERE reasons <> ''",
    "stream_windowed_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_first_deliveries": "SELECT event_id, user_id, event_type FROM events",
    "stream_task_states": f"WITH {LOG} SELECT workflow_id, task_id, arg_max(event_type, sequence) AS last_type, count(*) AS n_events FROM log WHERE event_type LIKE 'Task%' GROUP BY 1, 2",
}
