from __future__ import annotations

import json
import random

from linkpulse.operators.ingest import label, parse_lines
from linkpulse.schema import METRICS, PERCENT_METRICS, RAW_SCHEMA


def sample_metrics(seed: int = 7) -> dict:
    """Plausible metrics, drawn from a seed, in two decimals."""
    rng = random.Random(seed)
    top = {m: 95.0 if m in PERCENT_METRICS else 60.0 for m in METRICS}
    return {m: round(rng.uniform(1.0, most), 2) for m, most in top.items()}


def record(router="R1", timestamp="2026-10-08T12:00:00Z", **changes) -> dict:
    """A valid record, fields in the log's order."""
    whole = {"timestamp": timestamp, "router_id": router, **sample_metrics(), "status": "ACTIVE", "active_fault": None}
    return {**whole, **changes}


def line(*args, **changes) -> str:
    return json.dumps(record(*args, **changes))


def raw(spark, lines, src_file="log"):
    rows = [(text, src_file, (0, i)) for i, text in enumerate(lines)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def verdicts(spark, lines) -> list:
    """The reject reason of each line (None if accepted), in order."""
    got = label(parse_lines(raw(spark, lines))).orderBy("src_pos").collect()
    return [r["reject_reason"] for r in got]


def telemetry(spark, rows):
    """Records `(id, router, time, latency[, fault])` as a telemetry DataFrame."""
    from datetime import datetime

    full = []
    for id_, router, time, latency, *fault in rows:
        name = fault[0] if fault else None
        metrics = {**sample_metrics(), "latency": float(latency)}
        full.append(
            (id_, time, datetime.fromisoformat(time.rstrip("Z")), router, *metrics.values(), "FAULTED" if name else "ACTIVE", name)
        )
    return spark.createDataFrame(
        full,
        "id long, timestamp string, event_time timestamp, router_id string, latency double, "
        "packet_loss double, jitter double, bandwidth_usage double, cpu_usage double, "
        "memory_usage double, status string, active_fault string",
    )
