"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from ..schema import METRICS, PERCENT_METRICS

_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_FAULT = """CASE WHEN k % 7 = 0 THEN 'Latency Spike' WHEN k % 7 = 1 THEN 'Packet Loss Spike'
  WHEN k % 7 = 2 THEN 'High Jitter' WHEN k % 7 = 3 THEN 'Bandwidth Congestion'
  WHEN k % 7 = 4 THEN 'CPU Overload' WHEN k % 7 = 5 THEN 'Memory Overload'
  ELSE 'Link Failure' END"""

# Common table expressions: t telemetry, reg registry, sched schedule.
_T = f"""e AS (SELECT *, {_K} AS k FROM events),
t AS (SELECT event_id AS id, ts AS event_time, {_ISO.format("ts")} AS "timestamp",
 concat('R', CAST(user_id AS VARCHAR)) AS router_id, value AS latency,
 k * CAST(0.25 AS DOUBLE) AS packet_loss, value * CAST(0.125 AS DOUBLE) AS jitter,
 CAST(k AS DOUBLE) AS bandwidth_usage, CAST((k * 7 + 13) % 100 AS DOUBLE) AS cpu_usage,
 CAST((k * 3 + 29) % 100 AS DOUBLE) AS memory_usage,
 CASE WHEN event_type = 'error' THEN 'FAULTED' ELSE 'ACTIVE' END AS status,
 CASE WHEN event_type = 'error' THEN {_FAULT} END AS active_fault FROM e)"""
_REG = """reg AS (SELECT concat('R', CAST(c_custkey AS VARCHAR)) AS router_id, c_name AS name,
 CASE WHEN c_custkey % 2 = 1 THEN 'CORE' ELSE 'EDGE' END AS role FROM customer)"""
_SCHED = f"""sched AS (SELECT event_id AS seq, concat('R', CAST(user_id AS VARCHAR)) AS router_id,
 ts AS started_at, CAST(7200.0 AS DOUBLE) AS duration_s,
 CASE WHEN k % 10 = 0 THEN 'CPU Overload' ELSE {_FAULT} END AS fault_type,
 CASE WHEN k % 3 = 0 THEN 'Low' WHEN k % 3 = 1 THEN 'Medium' ELSE 'High' END AS intensity
 FROM e WHERE event_type = 'error')"""
_STATES = """states AS (SELECT router_id, event_time AS last_timestamp, latency, packet_loss, jitter,
 bandwidth_usage, cpu_usage, memory_usage, status, active_fault, n AS total_samples
 FROM (SELECT *, row_number() OVER (PARTITION BY router_id ORDER BY event_time DESC, id DESC) AS rn,
  count(*) OVER (PARTITION BY router_id) AS n FROM t) WHERE rn = 1)"""
_ANY = (
    "(latency > 50 OR packet_loss > 1 OR jitter > 10 OR bandwidth_usage > 80"
    " OR cpu_usage > 85 OR memory_usage > 85)"
)
_CRIT = "(latency > 100 OR packet_loss > 5 OR cpu_usage > 90)"
_HEALTH = f"CASE WHEN {_CRIT} THEN 'CRITICAL' WHEN {_ANY} THEN 'WARNING' ELSE 'HEALTHY' END"
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _with(sql: str, *extra: str) -> str:
    return "WITH " + ",\n".join((_T, *extra)) + "\n" + sql


def _r(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,6)), {digits}) AS DOUBLE)"


def _newest(where: str, n: int) -> str:
    return _with(f"SELECT * FROM t WHERE {where} ORDER BY event_time DESC, id DESC LIMIT {n}")


# Ratio of a breached metric to its critical limit, 0 where not breached.
_RATIOS = """CASE WHEN packet_loss > 1 THEN packet_loss / CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rl,
 CASE WHEN latency > 50 THEN latency / CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ry,
 CASE WHEN cpu_usage > 85 THEN cpu_usage / CAST(90 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rc"""
_MAIN = """CASE WHEN greatest(rl, ry, rc) <= 0 THEN NULL WHEN rl = greatest(rl, ry, rc) THEN 'packet_loss'
 WHEN ry = greatest(rl, ry, rc) THEN 'latency' ELSE 'cpu_usage' END"""
_MAINED = f"r AS (SELECT *, {_RATIOS} FROM t), m AS (SELECT *, {_MAIN} AS main FROM r)"


def _alerts() -> str:
    rules = [
        ("latency", 50, 100, "Latency Spike"),
        ("packet_loss", 1, 5, "Packet Loss Spike"),
        ("jitter", 10, None, "High Jitter"),
        ("bandwidth_usage", 80, None, "Bandwidth Congestion"),
        ("cpu_usage", 85, 90, "CPU Overload"),
        ("memory_usage", 85, None, "Memory Overload"),
    ]
    parts = []
    for name, warn, crit, fault in rules:
        level = "'WARNING'" if crit is None else (
            f"CASE WHEN {name} > {crit} THEN 'CRITICAL' ELSE 'WARNING' END"
        )
        parts.append(
            f"SELECT id, router_id, event_time, '{name}' AS metric, {name} AS value, "
            f"{level} AS severity, '{fault}' AS fault_name, "
            f"coalesce(main = '{name}', FALSE) AS \"primary\" FROM m WHERE {name} > {warn}"
        )
    return _with("\nUNION ALL ".join(parts), _MAINED)


# Each record with the means of its router's fault-free records.
_BASE = f"""base AS (SELECT router_id, {", ".join(f"avg({m}) AS base_{m}, stddev_pop({m}) AS spread_{m}" for m in METRICS)}
 FROM t WHERE active_fault IS NULL GROUP BY router_id)"""
_BASED = f"""{_BASE},
based AS (SELECT t.*, {", ".join(f"base_{m}" for m in METRICS)} FROM t LEFT JOIN base USING (router_id))"""
_EFFECTS = f"""effects AS (SELECT active_fault AS ef, count(*) AS n, {", ".join(f"avg({m} - base_{m}) AS effect_{m}" for m in METRICS)}
 FROM based WHERE active_fault IS NOT NULL GROUP BY 1)"""

_CLASS = """CASE WHEN packet_loss >= 100 AND latency >= 999 THEN 'Link Failure'
 WHEN bandwidth_usage >= 88 THEN 'Bandwidth Congestion' WHEN memory_usage >= 88 THEN 'Memory Overload'
 WHEN cpu_usage >= 91 THEN 'CPU Overload' WHEN packet_loss >= 4 THEN 'Packet Loss Spike'
 WHEN jitter - coalesce(base_jitter, 0) >= 10
  AND jitter - coalesce(base_jitter, 0) > (latency - coalesce(base_latency, 0)) * CAST(0.3 AS DOUBLE) THEN 'High Jitter'
 WHEN latency - coalesce(base_latency, 0) >= 49 THEN 'Latency Spike' END"""

_ASOF = """hit AS (SELECT based.*, s.fault_type AS ft, s.started_at AS fs, s.duration_s AS fd, s.intensity AS fi
 FROM based ASOF LEFT JOIN sched s ON based.router_id = s.router_id AND based.event_time >= s.started_at),
live AS (SELECT *, CASE WHEN event_time < fs + to_seconds(fd) THEN ft END AS fault_type FROM hit)"""


def _overlay() -> str:
    columns = []
    for m in METRICS:
        moved = f"greatest(CAST(0 AS DOUBLE), {m} + coalesce(effect_{m}, 0))"
        if m in PERCENT_METRICS:
            moved = f"least(CAST(100 AS DOUBLE), {moved})"
        columns.append(_r(f"CASE WHEN fault_type IS NOT NULL THEN {moved} ELSE {m} END", 4) + f" AS {m}")
    return _with(
        f"""SELECT id, router_id, {", ".join(columns)},
 CASE WHEN fault_type IS NOT NULL THEN 'FAULTED' ELSE status END AS status,
 coalesce(fault_type, active_fault) AS active_fault FROM live LEFT JOIN effects ON fault_type = ef""",
        _SCHED,
        _BASED,
        _EFFECTS,
        _ASOF,
    )


def _stats_columns(zero: bool = True) -> str:
    wrap = (lambda x: f"coalesce({x}, CAST(0 AS DOUBLE))") if zero else (lambda x: x)
    return ", ".join(
        f"{wrap(_r(f'{fn}({m})'))} AS {fn}_{m}" for m in METRICS for fn in ("min", "max", "avg")
    )


def _document(where: str, minutes: str) -> str:
    return _with(
        f"""SELECT count(*) AS total_records, count(DISTINCT router_id) AS router_count,
 (SELECT coalesce(string_agg(router_id, ',' ORDER BY router_id), '') FROM (SELECT DISTINCT router_id FROM w)) AS routers,
 min(event_time) AS earliest, max(event_time) AS latest, CAST({minutes} AS INT) AS time_window_minutes,
 {_stats_columns()},
 (SELECT coalesce(string_agg(concat(status, '=', n), ',' ORDER BY status), '')
  FROM (SELECT status, count(*) AS n FROM w GROUP BY status)) AS status_distribution,
 (SELECT coalesce(string_agg(concat(active_fault, '=', n), ',' ORDER BY active_fault), '')
  FROM (SELECT active_fault, count(*) AS n FROM w WHERE active_fault IS NOT NULL GROUP BY active_fault))
  AS fault_distribution
FROM w""",
        f"w AS (SELECT * FROM t WHERE {where})",
    )


def _stats_table() -> str:
    parts = [
        ("total", "CAST(NULL AS VARCHAR)", "TRUE", ""),
        ("status", "status", "TRUE", "GROUP BY status"),
        ("fault", "active_fault", "active_fault IS NOT NULL", "GROUP BY active_fault"),
        ("router", "router_id", "TRUE", "GROUP BY router_id"),
    ]
    return _with(
        "\nUNION ALL ".join(
            f"""SELECT '{part}' AS part, {key} AS key, count(*) AS records, min(event_time) AS earliest,
 max(event_time) AS latest, {_stats_columns()} FROM t WHERE {where} {group}"""
            for part, key, where, group in parts
        )
    )


_ARRIVED = """arrived AS (SELECT id AS arrival, id, router_id, "timestamp", latency, active_fault, event_time FROM t
 UNION ALL SELECT CASE WHEN id % 20 = 0 THEN id + 1000000000000 ELSE id - 1000000000000 END,
  id, router_id, "timestamp", latency + 1, active_fault, event_time FROM t WHERE id % 10 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY router_id, "timestamp" ORDER BY arrival) AS rn
 FROM arrived) WHERE rn = 1)"""

_REASON = """CASE id % 50 WHEN 0 THEN 'JSONDecodeError' WHEN 2 THEN 'latency: below_minimum'
 WHEN 3 THEN 'packet_loss: above_maximum' WHEN 4 THEN 'router_id: blank'
 WHEN 5 THEN 'cpu_usage: missing' WHEN 7 THEN 'not_object' END"""

_EPISODES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY router_id ORDER BY event_time, id)
  - row_number() OVER (PARTITION BY router_id, active_fault ORDER BY event_time, id) AS island,
 min(CASE WHEN active_fault IS NULL THEN event_time END) OVER (PARTITION BY router_id ORDER BY event_time, id
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS clear FROM t)"""

_RISK = f"""lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY router_id
  ORDER BY event_time DESC, id DESC) AS rn FROM t) WHERE rn <= 20),
scored AS (SELECT router_id, count(*) AS samples,
 CAST(round(CAST(count_if({_ANY}) / CAST(count(*) AS DOUBLE) AS DECIMAL(18,6)), 4) AS DOUBLE) AS score,
 concat_ws(',', CASE WHEN max(bandwidth_usage) > 80 THEN 'bandwidth_usage' END,
  CASE WHEN max(cpu_usage) > 85 THEN 'cpu_usage' END, CASE WHEN max(jitter) > 10 THEN 'jitter' END,
  CASE WHEN max(latency) > 50 THEN 'latency' END, CASE WHEN max(memory_usage) > 85 THEN 'memory_usage' END,
  CASE WHEN max(packet_loss) > 1 THEN 'packet_loss' END) AS metrics
 FROM lasts GROUP BY router_id)"""


def _text(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def oracles() -> dict[str, str]:
    """SQL by query name."""
    return {
        "telemetry_scan": _with("SELECT * FROM t"),
        "stored_latest_n": _newest("TRUE", 50),
        "stored_recent_window": _newest(f"event_time >= {_AS_OF} - INTERVAL 1440 MINUTE", 2000),
        "stored_router_history": _newest("router_id = 'R7'", 50),
        "stored_stats_week": _document(f"event_time >= {_AS_OF} - INTERVAL 10080 MINUTE", "10080"),
        "stored_router_stats": _with(
            f"""SELECT router_id, CAST(grouping(router_id) AS INT) AS is_total, count(*) AS sample_count,
 {_stats_columns(False)} FROM t GROUP BY ROLLUP (router_id)"""
        ),
        "stored_router_states": _with("SELECT * FROM states", _STATES),
        "stored_metadata": _with(
            """SELECT count(*) AS total_records, count(DISTINCT router_id) AS router_count, min(event_time) AS earliest,
 max(event_time) AS latest, TRUE AS has_files FROM t"""
        ),
        "log_tail_times": _with('SELECT "timestamp" FROM t WHERE id % 50 NOT IN (0, 1) ORDER BY id DESC LIMIT 50'),
        "recent_window": _newest(f"event_time >= {_AS_OF} - INTERVAL 1440 MINUTE", 2000),
        "recent_router_window": _newest(
            f"event_time >= {_AS_OF} - INTERVAL 1440 MINUTE AND router_id = 'R7'", 2000
        ),
        "recent_all": _newest("TRUE", 200),
        "router_history": _newest("router_id = 'R7'", 50),
        "latest_n": _newest("TRUE", 50),
        "live_tail": _newest("TRUE", 20),
        "history_per_router": _with(
            """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY router_id
 ORDER BY event_time DESC, id DESC) AS rank FROM t) WHERE rank <= 5"""
        ),
        "fault_records_any": _with(
            """SELECT id, router_id, status, active_fault FROM t
WHERE status = 'FAULTED' OR coalesce(active_fault, '') <> ''"""
        ),
        "event_lines": _with(
            f"""SELECT id, router_id, concat('[', substr("timestamp", 12, 12), '] ', router_id, ' ',
 {_text("latency")}, 'ms | ', {_text("packet_loss")}, '% | ', {_text("jitter")}, 'ms | BW:',
 {_text("bandwidth_usage")}, '% | CPU:', {_text("cpu_usage")}, '% | MEM:', {_text("memory_usage")}, '% ',
 CASE WHEN status = 'FAULTED' OR coalesce(active_fault, '') <> ''
  THEN concat('[FAULT: ', coalesce(nullif(active_fault, ''), 'PERTURB'), ']') ELSE '[NOMINAL]' END) AS line
FROM t"""
        ),
        "router_states": _with("SELECT * FROM states", _STATES),
        "latest_per_router": _with(
            """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY router_id
 ORDER BY event_time DESC, id DESC) AS rn FROM t) WHERE rn = 1"""
        ),
        "registry_view": _with(
            f"""SELECT reg.router_id, reg.name, reg.role, a.fault_type, a.intensity, a.started_at,
 s.last_timestamp, {", ".join("s." + m for m in METRICS)}, a.router_id IS NOT NULL AS has_fault,
 CASE WHEN a.router_id IS NOT NULL THEN 'FAULTED' ELSE 'ACTIVE' END AS status
FROM reg LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY router_id
  ORDER BY started_at DESC, seq DESC) AS rn FROM sched WHERE started_at <= {_AS_OF})
  WHERE rn = 1 AND {_AS_OF} < started_at + to_seconds(duration_s)) a ON reg.router_id = a.router_id
LEFT JOIN states s ON reg.router_id = s.router_id""",
            _REG,
            _SCHED,
            _STATES,
        ),
        "known_routers": _with(
            "SELECT router_id FROM reg WHERE router_id IN (SELECT router_id FROM t)", _REG
        ),
        "unknown_routers": _with(
            "SELECT router_id FROM reg WHERE router_id NOT IN (SELECT router_id FROM t)", _REG
        ),
        "natural_rank": _with(
            """SELECT router_id, row_number() OVER (ORDER BY length(router_id), router_id) AS natural_rank
FROM (SELECT DISTINCT router_id FROM t)"""
        ),
        "fault_badges": _with(
            "SELECT count(*) AS routers, CAST(count_if(status = 'FAULTED') AS BIGINT) AS faulted FROM states", _STATES
        ),
        "fault_schedule_clean": _with(
            "SELECT seq, router_id, started_at, duration_s, fault_type, intensity FROM sched", _SCHED
        ),
        "link_status": _with(
            """SELECT e2.src AS src_router, e2.dst AS dst_router,
 CASE WHEN a.health = 'CRITICAL' OR b.health = 'CRITICAL' THEN 'CRITICAL'
  WHEN a.health = 'WARNING' OR b.health = 'WARNING' THEN 'WARNING' ELSE 'HEALTHY' END AS status
FROM (SELECT DISTINCT concat('R', user_id) AS src, concat('R', user_id + 1) AS dst FROM events) e2
LEFT JOIN h a ON e2.src = a.router_id LEFT JOIN h b ON e2.dst = b.router_id""",
            _STATES,
            f"h AS (SELECT router_id, {_HEALTH} AS health FROM states)",
        ),
        "summary": _with(
            """SELECT count(*) AS total_records, count(DISTINCT router_id) AS router_count,
 min(event_time) AS earliest, max(event_time) AS latest FROM t"""
        ),
        "metric_stats": _with(
            "\nUNION ALL ".join(
                f"SELECT '{m}' AS metric, {_r(f'min({m})')} AS min, {_r(f'max({m})')} AS max, "
                f"{_r(f'avg({m})')} AS avg FROM t"
                for m in METRICS
            )
        ),
        "status_distribution": _with("SELECT status, count(*) AS records FROM t GROUP BY status"),
        "fault_distribution": _with(
            """SELECT active_fault, count(*) AS records FROM t WHERE active_fault IS NOT NULL
GROUP BY active_fault"""
        ),
        "sample_counts": _with(
            "SELECT router_id, count(*) AS sample_count FROM t GROUP BY router_id"
        ),
        "distinct_routers": _with("SELECT DISTINCT router_id FROM t ORDER BY router_id"),
        "router_stats_rollup": _with(
            f"""SELECT router_id, CAST(grouping(router_id) AS INT) AS is_total, count(*) AS sample_count,
 {_stats_columns(False)} FROM t GROUP BY ROLLUP (router_id)"""
        ),
        "stats_table": _stats_table(),
        "stats_document": _document("TRUE", "NULL"),
        "stats_window": _document(f"event_time >= {_AS_OF} - INTERVAL 1440 MINUTE", "1440"),
        "stats_empty_window": _document(
            "event_time >= TIMESTAMP '2030-01-01 00:00:00' - INTERVAL 60 MINUTE", "60"
        ),
        "ingest_valid": _with(
            f"""SELECT id AS line, "timestamp", router_id, {", ".join(METRICS)}, status, active_fault
FROM t WHERE id % 50 NOT IN (0, 1, 2, 3, 4, 5, 7)"""
        ),
        "ingest_rejects": _with(
            f"""SELECT id AS line, {_REASON} AS reject_reason FROM t
WHERE id % 50 IN (0, 2, 3, 4, 5, 7)"""
        ),
        "reject_reason_counts": _with(
            f"""SELECT {_REASON} AS reject_reason, count(*) AS lines FROM t
WHERE id % 50 IN (0, 2, 3, 4, 5, 7) GROUP BY 1"""
        ),
        "canonical_record": _with(
            f"""SELECT "timestamp", router_id, {_r("latency")} AS latency, {_r("packet_loss")} AS packet_loss,
 {_r("jitter")} AS jitter, {_r("bandwidth_usage", 1)} AS bandwidth_usage,
 {_r("cpu_usage", 1)} AS cpu_usage, {_r("memory_usage", 1)} AS memory_usage, status, active_fault FROM t"""
        ),
        "log_tail_lines": _with(
            "SELECT id AS line FROM t WHERE id % 50 NOT IN (0, 1) ORDER BY id DESC LIMIT 50"
        ),
        "dedup_first_arrival": _with(
            'SELECT arrival, id, router_id, "timestamp", latency, active_fault FROM firsts', _ARRIVED
        ),
        "insert_or_ignore": _with(
            """SELECT arrival, id, router_id, "timestamp", latency, active_fault FROM firsts
WHERE (router_id, "timestamp") NOT IN (SELECT (router_id, "timestamp") FROM t
 WHERE event_time < TIMESTAMP '2024-01-16 00:00:00')""",
            _ARRIVED,
        ),
        "upsert_last_write": """SELECT key, value, updated_at, write_no FROM (
SELECT concat(event_type, '/', props) AS key, user_id AS value, ts AS updated_at, event_id AS write_no,
 row_number() OVER (PARTITION BY event_type, props ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
        "ingest_status": f"""WITH b AS (SELECT event_id // 500 AS batch_id, count(*) AS lines_read,
 count_if(event_type <> 'error') AS inserted, count_if(event_type = 'error') AS errors, max(ts) AS polled_at,
 max(CASE WHEN event_type = 'error' THEN props END) AS last_error,
 max(CASE WHEN event_type <> 'error' THEN {_ISO.format("ts")} END) AS last_imported_timestamp
 FROM events GROUP BY 1)
SELECT count(*) AS batches, CAST(sum(lines_read) AS BIGINT) AS total_lines_read,
 CAST(sum(inserted) AS BIGINT) AS total_records_inserted,
 CAST(sum(errors) AS BIGINT) AS total_errors_encountered, max(polled_at) AS last_poll_time,
 (SELECT last_error FROM b WHERE last_error IS NOT NULL ORDER BY polled_at DESC, batch_id DESC LIMIT 1)
  AS last_error,
 (SELECT last_imported_timestamp FROM b WHERE last_imported_timestamp IS NOT NULL
  ORDER BY polled_at DESC, batch_id DESC LIMIT 1) AS last_imported_timestamp
FROM b""",
        "fault_asof": _with(
            """SELECT id, router_id, event_time, fault_type, CASE WHEN fault_type IS NOT NULL THEN fi END AS intensity,
 CASE WHEN fault_type IS NOT NULL THEN fs END AS started_at FROM live""",
            _SCHED,
            _BASED,
            _ASOF,
        ),
        "fault_overlay": _overlay(),
        "fault_episodes": _with(
            """SELECT router_id, active_fault, min(event_time) AS started_at, max(event_time) AS ended_at,
 count(*) AS samples, max(clear) AS recovered_at FROM numbered WHERE active_fault IS NOT NULL
GROUP BY router_id, active_fault, island""",
            _EPISODES,
        ),
        "baseline_profile": _with(
            f"""SELECT router_id, {", ".join(f"{_r(f'{k}_{m}', 4)} AS {k}_{m}" for k in ("base", "spread") for m in METRICS)}
FROM base""",
            _BASE,
        ),
        "baseline_deviation": _with(
            f"""SELECT id, router_id, {", ".join(f"{_r(f'{m} - base_{m}', 4)} AS dev_{m}" for m in METRICS)}
FROM based""",
            _BASED,
        ),
        "congestion_terms": _with(
            f"""SELECT CAST(floor(bandwidth_usage / 10) * 10 AS INT) AS band, count(*) AS records,
 {", ".join(f"{_r(f'avg({m})', 4)} AS {m}" for m in ("latency", "jitter", "packet_loss"))} FROM t GROUP BY 1"""
        ),
        "fault_effects": _with(
            f"""SELECT ef AS fault_type, n AS records, {", ".join(f"{_r('effect_' + m, 4)} AS effect_{m}" for m in METRICS)}
FROM effects""",
            _BASED,
            _EFFECTS,
        ),
        "classify_fault": _with(
            f"SELECT id, router_id, active_fault, {_CLASS} AS predicted_fault FROM based", _BASED
        ),
        "fault_confusion": _with(
            f"""SELECT active_fault, {_CLASS} AS predicted_fault, count(*) AS records FROM based
GROUP BY 1, 2""",
            _BASED,
        ),
        "alerts": _alerts(),
        "router_health": _with(f"SELECT router_id, {_HEALTH} AS health FROM states", _STATES),
        "event_feed": _with(
            """SELECT id, router_id, event_time,
 CASE main WHEN 'packet_loss' THEN 'PACKET_LOSS' WHEN 'latency' THEN 'LATENCY_SPIKE'
  WHEN 'cpu_usage' THEN 'CPU_WARNING' ELSE 'TELEMETRY_UPDATE' END AS event,
 CASE main WHEN 'packet_loss' THEN packet_loss WHEN 'latency' THEN latency WHEN 'cpu_usage' THEN cpu_usage END
  AS value FROM m""",
            _MAINED,
        ),
        "kpis": _with(
            f"""SELECT {_r(f"count_if({_HEALTH} = 'HEALTHY') * 100 / CAST(count(*) AS DOUBLE)")} AS health_pct,
 (SELECT {_r("100 - count_if(active_fault = 'Link Failure') * 100 / CAST(count(*) AS DOUBLE)")} FROM t)
  AS availability_pct,
 count(*) AS routers_reporting,
 CAST(sum((latency > 50)::INT + (packet_loss > 1)::INT + (jitter > 10)::INT + (bandwidth_usage > 80)::INT
  + (cpu_usage > 85)::INT + (memory_usage > 85)::INT) AS BIGINT) AS open_alerts,
 (SELECT count(DISTINCT router_id) FROM reg) AS routers_registered FROM states""",
            _REG,
            _STATES,
        ),
        "risk": _with(
            """SELECT *, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END
 AS level FROM scored""",
            _RISK,
        ),
        "perf_series_hourly": _with(
            f"""SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS bucket_start, role, count(*) AS samples,
 {_r("avg(cpu_usage)")} AS avg, max(cpu_usage) AS max
FROM t LEFT JOIN reg USING (router_id) GROUP BY 1, 2""",
            _REG,
        ),
        "perf_series_sliding": _with(
            f"""SELECT time_bucket(INTERVAL 1 HOUR, event_time) - to_hours(b.i) AS bucket_start, role,
 count(*) AS samples, {_r("avg(latency)")} AS avg, max(latency) AS max
FROM (SELECT * FROM t LEFT JOIN reg USING (router_id)), range(6) AS b(i) GROUP BY 1, 2""",
            _REG,
        ),
        "network_series_daily": _with(
            f"""SELECT time_bucket(INTERVAL 1 DAY, event_time) AS bucket_start, 'network' AS scope,
 count(*) AS samples, {_r("avg(latency)")} AS avg, max(latency) AS max FROM t GROUP BY 1"""
        ),
    }
