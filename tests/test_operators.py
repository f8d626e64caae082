from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest

from linkpulse.functions import plain_number, round_dp, row_count
from linkpulse.operators import faults, health, ledger, registry, select, series, stats, timeline
from linkpulse.schema import FAULT_TYPES, LATEST_ROWS, LEDGER_SCHEMA, METRICS
from tests.helpers import sample_metrics, telemetry

T0 = datetime(2026, 10, 8, 10, 0, 0)


@pytest.fixture(scope="module")
def three(spark):
    return telemetry(
        spark,
        [
            (1, "R1", "2026-10-08T10:00:00Z", 10),
            (2, "R1", "2026-10-08T10:01:00Z", 20),
            (3, "R2", "2026-10-08T10:02:00Z", 30, "Latency Spike"),
        ],
    ).cache()


def test_queries_on_three_records(three):
    assert select.latest(three).first().router_id == "R2"
    assert [r.latency for r in select.router_history(three, " R1 ").collect()] == [20.0, 10.0]
    states = {r.router_id: r for r in registry.router_states(three).collect()}
    assert (states["R2"].latency, states["R2"].active_fault, states["R2"].total_samples) == (
        30.0, "Latency Spike", 1,
    )
    assert (states["R1"].latency, states["R1"].total_samples) == (20.0, 2)
    doc = stats.stats(three).first()
    assert (doc.total_records, doc.router_count, doc.routers) == (3, 2, ["R1", "R2"])
    latency = doc.metrics["latency"]
    assert (latency["min"], latency["max"], latency["avg"]) == (10.0, 30.0, 20.0)
    assert doc.fault_distribution == {"Latency Spike": 1}
    assert doc.status_distribution == {"ACTIVE": 2, "FAULTED": 1}
    assert doc.time_window_minutes is None


def test_windows(three):
    as_of = "2026-10-08 10:03:00"
    assert select.recent(three, 2, as_of=as_of).count() == 2
    assert select.recent(three, 2, "R1", as_of=as_of).count() == 1
    assert select.recent(three, 0).count() == 3 and select.recent(three, router_id="").count() == 3
    assert stats.stats(three, 1, as_of).first().time_window_minutes == 1
    assert select.recent(three, 5).count() == 0  # counted back from now
    assert select.recent(three, 20_000, as_of=as_of).count() == 3
    with pytest.raises(ValueError):
        select.recent(three, -1)


def test_empty_input(three):
    none = three.limit(0)
    doc = stats.stats(none).first()
    assert (doc.total_records, doc.router_count, doc.routers, doc.earliest) == (0, 0, [], None)
    assert doc.status_distribution == {} and doc.fault_distribution == {}
    assert all(tuple(doc.metrics[m]) == (0.0, 0.0, 0.0) for m in METRICS)
    assert {tuple(r)[1:] for r in stats.metric_stats(none).collect()} == {(0.0, 0.0, 0.0)}
    assert select.latest(none).count() == 0
    assert stats.summary(none, approx=True).first().total_records == 0
    assert health.kpis(none, none).first().health_pct is None


def test_limits():
    assert [row_count(n, LATEST_ROWS) for n in (None, 1, 7, 5000)] == [50, 1, 7, 5000]
    for n in (0, -5):
        with pytest.raises(ValueError):
            row_count(n, LATEST_ROWS)


def test_no_row_is_cut_off(spark):
    many = spark.range(3000).selectExpr("id", "'R1' router_id", "timestamp'2026-10-08 10:00:00' + make_dt_interval(0, 0, 0, id) event_time")
    assert select.latest(many, 2500).count() == 2500
    assert select.recent(many, minutes=30, n=5000, as_of="2026-10-08 11:00:00").count() == 1200
    assert select.history_per_router(many, 2900).count() == 2900


def test_numbers(spark):
    values = [0.0005, 12345678.5, 40.0, -0.00025, 1e13, 123.456, 0.0, 3e-5, 1e300, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(plain_number("x").alias("t"), "x").collect()
    assert [r.t for r in got[:8]] == ["0.0005", "12345678.5", "40", "-0.00025", "10000000000000", "123.456", "0", "0.00003"]
    assert all(float(r.t) == r.x for r in got)
    big = spark.createDataFrame([(1e13 + 0.126,), (1e40,)], "x double").select(round_dp("x", 2).alias("y")).collect()
    assert [r.y for r in big] == [round(1e13 + 0.126, 2), 1e40]


def test_newest_with_ties_and_rows_without_time(spark):
    rows = [(i, "R1", f"2026-10-08T10:{m:02d}:00Z", i) for i, m in enumerate([5, 5, 4, 5, 3])]
    df = telemetry(spark, rows)
    untimed = df.limit(1).selectExpr(
        *[f"cast(null as {t}) {c}" if c == "event_time" else (f"99L {c}" if c == "id" else c)
          for c, t in df.dtypes]
    )
    both = df.unionByName(untimed).repartition(3)
    assert [r.id for r in select.latest(both, 4).collect()] == [3, 1, 0, 2]
    assert [r.id for r in select.latest(both, 10).collect()] == [3, 1, 0, 2, 4, 99]
    assert [r.id for r in select.live_tail(both, 3, 2).collect()] == [1, 3]


def test_newest_per_router_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        # One router has most of the rows.
        (i, "R1" if rng.random() < 0.7 else f"R{rng.randint(2, 6)}",
         (T0 + timedelta(seconds=rng.randint(0, 300))).isoformat() + "Z", i)
        for i in range(400)
    ]
    got = select.history_per_router(telemetry(spark, rows).repartition(7), 5).collect()
    want = []
    for router in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == router), key=lambda r: (r[2], r[0]), reverse=True)
        want += [(router, n + 1, r[0]) for n, r in enumerate(mine[:5])]
    assert sorted((r.router_id, r.rank, r.id) for r in got) == sorted(want)


def test_event_lines(three):
    lines = [r.line for r in select.event_lines(three).orderBy("id").collect()]
    own = sample_metrics()
    assert lines[0] == (
        f"[10:00:00Z] R1 10ms | {own['packet_loss']}% | {own['jitter']}ms | BW:{own['bandwidth_usage']}% |"
        f" CPU:{own['cpu_usage']}% | MEM:{own['memory_usage']}% [NOMINAL]"
    )
    assert lines[2].endswith("[FAULT: Latency Spike]")


# --- Registry ---


def test_registry_and_natural_order(spark):
    reg = spark.createDataFrame(
        [(" r10 ", "Core"), ("r2", "  "), ("R1", None), ("R30", "x")], "router_id string, name string"
    )
    clean = registry.clean_registry(reg)
    assert {r.router_id: r.name for r in clean.collect()} == {
        "R10": "Core", "R2": "Router R2", "R1": "Router R1", "R30": "x",
    }
    assert [r.router_id for r in registry.natural_order(clean).collect()] == ["R1", "R2", "R10", "R30"]
    ranks = {r.router_id: r.natural_rank for r in registry.natural_rank(clean).collect()}
    assert ranks == {"R1": 1, "R2": 2, "R10": 3, "R30": 4}


def test_schedule_names_and_expiry(spark):
    sched = spark.createDataFrame(
        [
            (1, " r1 ", T0, 60.0, "High Jitter", "Low"),
            (2, "R1", T0 + timedelta(seconds=30), 10.0, "Nonsense", "Extreme"),
            (3, "R2", T0, 30.0, "Link Failure", "Medium"),
        ],
        "seq long, router_id string, started_at timestamp, duration_s double, fault_type string, intensity string",
    )
    clean = registry.clean_schedule(sched)
    assert {(r.router_id, r.fault_type, r.intensity) for r in clean.collect()} == {
        ("R1", "High Jitter", "Low"), ("R1", "CPU Overload", "High"), ("R2", "Link Failure", "Medium"),
    }

    def active(second):
        now = T0 + timedelta(seconds=second)
        return {r.router_id: r.fault_type for r in registry.active_faults(clean, now).collect()}

    assert active(5) == {"R1": "High Jitter", "R2": "Link Failure"}
    assert active(35) == {"R1": "CPU Overload"}
    # The newer fault replaced the older one, which does not come back.
    assert active(45) == {} and active(-1) == {}


def test_registry_view_keeps_silent_routers(spark, three):
    reg = spark.createDataFrame([("R2", "b"), ("R9", "c")], "router_id string, name string")
    sched = spark.createDataFrame(
        [(1, "R2", T0, 1e6, "High Jitter", "Low")],
        "seq long, router_id string, started_at timestamp, duration_s double, fault_type string, intensity string",
    )
    active = registry.active_faults(sched, "2026-10-08 10:05:00")
    view = {r.router_id: r for r in registry.registry_view(reg, active, registry.router_states(three)).collect()}
    assert (view["R2"].has_fault, view["R2"].status, view["R2"].latency) == (True, "FAULTED", 30.0)
    assert (view["R9"].has_fault, view["R9"].status, view["R9"].latency) == (False, "ACTIVE", None)


# --- Time lines, against brute force over bucket borders ---


def _random_line(seed, n=250):
    rng = random.Random(seed)
    rows, used = [], set()
    for i in range(n):
        router = "R1" if rng.random() < 0.6 else f"R{rng.randint(2, 4)}"
        second = rng.randint(0, 4000)
        if (router, second) in used:
            continue
        used.add((router, second))
        fault = rng.choice([None, None, *FAULT_TYPES[:2]])
        rows.append((i, router, (T0 + timedelta(seconds=second)).isoformat() + "Z", 1.0, fault))
    return rows


@pytest.mark.parametrize("bucket", [60, 700, 100_000])
def test_fault_episodes(spark, bucket):
    rows = _random_line(bucket)
    want = []
    for router in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == router), key=lambda r: r[2])
        runs = [list(g) for _, g in itertools.groupby(mine, key=lambda r: r[4])]
        for i, run in enumerate(runs):
            if run[0][4]:
                later = [r for q in runs[i + 1:] for r in q if r[4] is None]
                want.append((router, run[0][4], run[0][2], run[-1][2], len(run), later[0][2] if later else "None"))
    got = timeline.fault_episodes(telemetry(spark, rows).repartition(4), bucket).collect()

    def iso(t):
        return t.isoformat() + "Z" if t else "None"

    assert sorted(
        (r.router_id, r.active_fault, iso(r.started_at), iso(r.ended_at), r.samples, iso(r.recovered_at))
        for r in got
    ) == sorted(want)


@pytest.mark.parametrize("bucket", [60, 700, 100_000])
def test_fault_asof(spark, bucket):
    rng = random.Random(bucket)
    rows = _random_line(bucket)
    sched = [
        (i, rng.choice(["R1", "R1", "R2", "R5"]), T0 + timedelta(seconds=rng.randint(-100, 3000)),
         float(rng.choice([5, 200, 1500, 1e7])), rng.choice(FAULT_TYPES), "High")
        for i in range(25)
    ]
    sched_df = spark.createDataFrame(
        sched,
        "seq long, router_id string, started_at timestamp, duration_s double, fault_type string, intensity string",
    )
    got = timeline.active_fault_asof(telemetry(spark, rows).repartition(4), sched_df, bucket)
    want = {}
    for id_, router, time, *_ in rows:
        now = datetime.fromisoformat(time.rstrip("Z"))
        before = [s for s in sched if s[1] == router and s[2] <= now]
        hit = max(before, key=lambda s: (s[2], s[0])) if before else None
        alive = hit and now < hit[2] + timedelta(seconds=hit[3])
        want[id_] = (hit[4], hit[2]) if alive else (None, None)
    assert {r.id: (r.fault_type, r.started_at) for r in got.collect()} == want


# --- Faults and health ---


def _faulted_fleet(spark):
    """Two routers at different levels; faults raise them by known amounts."""
    normal = {"A": (10.0, 0.5, 2.0, 30.0, 20.0, 40.0), "B": (40.0, 1.0, 4.0, 50.0, 60.0, 50.0)}
    raised = {"Latency Spike": (60.0, 0, 1.0, 0, 0, 0), "High Jitter": (20.0, 0, 30.0, 0, 0, 0), "CPU Overload": (5.0, 0, 0, 0, 38.0, 0)}
    rows, n = [], 0
    for router, level in normal.items():
        for wobble in (-1.0, 1.0):
            rows.append((n := n + 1, router, T0, *[v + wobble * 0.1 for v in level], "ACTIVE", None))
        for fault, rise in raised.items():
            rows.append((n := n + 1, router, T0, *[v + r for v, r in zip(level, rise)], "FAULTED", fault))
    schema = "id long, router_id string, event_time timestamp, " + ", ".join(f"{m} double" for m in METRICS) + ", status string, active_fault string"
    return spark.createDataFrame(rows, schema), normal, raised


def test_levels_come_from_fault_free_records(spark):
    df, normal, raised = _faulted_fleet(spark)
    for r in faults.baseline(df).collect():
        assert [r[f"base_{m}"] for m in METRICS] == pytest.approx(list(normal[r.router_id]))
        assert r.spread_latency == pytest.approx(0.1)
    for r in faults.fault_effects(df).collect():
        assert [r[f"effect_{m}"] for m in METRICS] == pytest.approx(list(raised[r.fault_type])) and r.records == 2


def test_classification_and_overlay(spark):
    df, normal, raised = _faulted_fleet(spark)
    seen = {(r.router_id, r.active_fault): r.predicted_fault for r in faults.classify_fault(df).collect()}
    assert all(seen[x, f] == f for x in "A" for f in ("Latency Spike", "High Jitter", None))
    assert seen["B", "CPU Overload"] == "CPU Overload" and seen["B", None] is None
    assert faults.confusion(faults.classify_fault(df)).filter("active_fault is null and predicted_fault is null").first().records == 4
    sched = spark.createDataFrame(
        [(1, "A", T0 - timedelta(seconds=5), 60.0, "CPU Overload", "High"), (2, "B", T0 - timedelta(seconds=90), 60.0, "High Jitter", "Low")],
        "seq long, router_id string, started_at timestamp, duration_s double, fault_type string, intensity string",
    )
    calm = df.filter("active_fault is null")
    over = {r.id: r for r in faults.apply_faults(df, sched).collect()}
    for r in calm.collect():
        hit = over[r.id]
        if r.router_id == "A":
            assert hit.cpu_usage == pytest.approx(r.cpu_usage + 38) and hit.active_fault == "CPU Overload"
        else:
            assert hit.cpu_usage == r.cpu_usage and hit.active_fault is None
    assert max(r.cpu_usage for r in over.values()) <= 100


def test_load_profile(spark):
    df, *_ = _faulted_fleet(spark)
    got = {r.band: r.records for r in faults.load_profile(df).collect()}
    assert got == {20: 1, 30: 4, 40: 1, 50: 4}


def test_series_keeps_unregistered_routers(spark, three):
    reg = registry.clean_registry(spark.createDataFrame([("r1 ", "a", "CORE"), ("R1", "b", "EDGE")], "router_id string, name string, role string"))
    assert reg.count() == 1
    got = series.perf_series(three, "latency", registry=reg).collect()
    assert {(r.role, r.samples) for r in got} == {("EDGE", 2), (None, 1)}


def test_episodes_cost_grows_with_the_rows(spark):
    """No frame looks ahead to the end of a line: that would cost the square of a router's rows."""
    df = spark.range(10).selectExpr("id", "'R1' router_id", "timestamp'2026-10-08 10:00:00' + make_dt_interval(0, id) event_time", "if(id % 2 = 0, 'x', null) active_fault")
    text = timeline.fault_episodes(df)._jdf.queryExecution().executedPlan().toString()
    assert "1, unboundedfollowing" not in text.lower() and "currentrow$(), unboundedfollowing" not in text.lower()


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [
        ("R1", 32, 45, 14, 0.1), ("R2", 28, 36, 15, 0.0), ("R3", 74, 62, 45, 1.2), ("R4", 41, 39, 12, 0.1),
        ("R5", 92, 88, 120, 8.4), ("R6", 22, 31, 11, 0.0), ("R7", 35, 40, 16, 0.1), ("R8", 87, 45, 22, 0.3),
    ]
    return spark.createDataFrame(
        [(n, r, T0, float(lat), float(loss), 2.0, 40.0, float(cpu), float(mem), "ACTIVE", None)
         for n, (r, cpu, mem, lat, loss) in enumerate(rows)],
        "id long, router_id string, event_time timestamp, "
        + ", ".join(f"{m} double" for m in METRICS) + ", status string, active_fault string",
    ).cache()


def test_health_alerts_and_links(spark, fleet):
    level = {r.router_id: r.health for r in health.router_health(fleet).collect()}
    assert [level[f"R{n}"] for n in range(1, 9)] == [
        "HEALTHY", "HEALTHY", "WARNING", "HEALTHY", "CRITICAL", "HEALTHY", "HEALTHY", "WARNING",
    ]
    rows = health.alerts(fleet).collect()
    assert {(r.router_id, r.metric, r.severity) for r in rows if r.primary} == {
        ("R3", "packet_loss", "WARNING"), ("R5", "packet_loss", "CRITICAL"), ("R8", "cpu_usage", "WARNING"),
    }
    assert {r.metric for r in rows if r.router_id == "R5"} == {
        "latency", "packet_loss", "cpu_usage", "memory_usage",
    }
    edges = spark.createDataFrame(
        [("R1", "R2"), ("R2", "R3"), ("R1", "R4"), ("R2", "R5"), ("R4", "R5"), ("R3", "R5"), ("R1", "R99")],
        "src_router string, dst_router string",
    )
    links = registry.link_status(edges, health.router_health(fleet)).collect()
    assert {(r.src_router, r.dst_router): r.status for r in links} == {
        ("R1", "R2"): "HEALTHY", ("R2", "R3"): "WARNING", ("R1", "R4"): "HEALTHY",
        ("R2", "R5"): "CRITICAL", ("R4", "R5"): "CRITICAL", ("R3", "R5"): "CRITICAL", ("R1", "R99"): "HEALTHY",
    }
    events = {r.router_id: (r.event, r.value) for r in health.event_feed(fleet).collect()}
    assert events["R5"] == ("PACKET_LOSS", 8.4) and events["R1"] == ("TELEMETRY_UPDATE", None)
    assert events["R8"] == ("CPU_WARNING", 87.0)
    assert registry.fault_badges(fleet).first().routers == 8


def test_kpis_and_risk(fleet):
    k = health.kpis(fleet, fleet.limit(4)).first()
    assert (k.health_pct, k.availability_pct, k.routers_reporting, k.routers_registered) == (62.5, 100.0, 8, 4)
    assert k.open_alerts == 6
    levels = {r.router_id: (r.score, r.level, r.metrics) for r in health.risk(fleet).collect()}
    assert levels["R1"] == (0.0, "LOW", []) and levels["R8"] == (1.0, "HIGH", ["cpu_usage"])


def test_ingest_status_counts_replays_once(spark):
    rows = [
        ("q/0", 0, 10, 8, 2, T0, "bad", "a"), ("q/0", 0, 10, 8, 2, T0, "bad", "a"),
        ("q/1", 1, 5, 5, 0, T0 + timedelta(seconds=1), None, "b"),
    ]
    got = ledger.ingest_status(spark.createDataFrame(rows, LEDGER_SCHEMA)).first()
    assert (got.total_lines_read, got.total_records_inserted, got.total_errors_encountered) == (15, 13, 2)
    assert (got.last_error, got.last_imported_timestamp) == ("bad", "b")
    none = ledger.ingest_status(spark.createDataFrame([], LEDGER_SCHEMA)).first()
    assert (none.total_lines_read, none.last_poll_time) == (0, None)
