from __future__ import annotations

import json

from linkpulse.operators.ingest import (
    accepted, canonicalize, first_arrival, label, parse_lines, rejected, strict_times, validate,
)
from linkpulse.schema import RECORD_FIELDS
from tests.helpers import line, raw, record, verdicts


def test_good_and_invalid_values(spark):
    got = verdicts(
        spark,
        [
            line(), line(latency=-5.0), line(packet_loss=105.0), line("   "), line("\t\n"),
            line(timestamp=" "), line(memory_usage=100.0), line(jitter=-0.001), line(cpu_usage=100.01),
        ],
    )
    assert got == [
        None, "latency: below_minimum", "packet_loss: above_maximum", "router_id: blank",
        "router_id: blank", "timestamp: blank", None, "jitter: below_minimum",
        "cpu_usage: above_maximum",
    ]


def test_malformed_json(spark):
    got = verdicts(
        spark,
        [
            line(), line()[1:], '{"router_id": "R1"}', line(), "[1, 2]", "7", '"text"',
            "null", line() + " x", line() + line(), line() + ", {}", "[" + line() + "]", "{}",
            line()[:-1],
        ],
    )
    assert got == [
        None, "JSONDecodeError", "timestamp: missing", None, "not_object", "not_object",
        "not_object", "not_object", "JSONDecodeError", "JSONDecodeError", "JSONDecodeError",
        "not_object", "timestamp: missing", "JSONDecodeError",
    ]


def test_blank_lines_are_no_errors(spark):
    lines = ["", "  ", "\t\r", "\u00a0\u2003", line()]
    assert verdicts(spark, lines) == ["blank"] * 4 + [None]
    valid, rejects = validate(parse_lines(raw(spark, lines)))
    assert valid.count() == 1 and rejects.count() == 0


def test_space_around_the_line(spark):
    assert verdicts(spark, [" \t" + line() + "  \r", " " + line()]) == [None, None]


def test_lax_numbers(spark):
    lines = [
        line(latency="7.25"), line(latency=" 1e2 "), line(latency=True), line(latency=7),
        line(latency="7.25d"), line(latency="abc"), line(latency=None), line(latency=[1]),
        line(latency={}), line(latency=""),
    ]
    df = label(parse_lines(raw(spark, lines))).orderBy("src_pos")
    got = [(r["latency"], r["reject_reason"]) for r in df.collect()]
    bad = "latency: not_a_number"
    assert got[:4] == [(7.25, None), (100.0, None), (1.0, None), (7.0, None)]
    assert [reason for _, reason in got[4:]] == [bad] * 6


def test_non_finite_numbers(spark):
    lines = [
        line(latency=float("nan")), line(latency=float("inf")), line(cpu_usage=float("-inf")),
        line(latency=-77.5).replace("-77.5", "1e400"), line(latency="nan"), line(jitter="-Infinity"),
        line(active_fault="a: NaN, b"), '{"x": NaN',
    ]
    assert verdicts(spark, lines) == [
        "non_finite", "non_finite", "non_finite", "latency: non_finite", "latency: non_finite",
        "jitter: non_finite", None, "JSONDecodeError",
    ]


def test_text_fields(spark):
    lines = [
        line(7), line(None), line(timestamp=5), line(status=None), line(status=3),
        line(active_fault=None), line(active_fault=1), line("R" * 64), line("R" * 65),
        line("  " + "R" * 64 + "\t"),
    ]
    assert verdicts(spark, lines) == [
        "router_id: not_a_string", "router_id: not_a_string", "timestamp: not_a_string",
        "status: not_a_string", "status: not_a_string", None, "active_fault: not_a_string", None,
        "router_id: too_long", None,
    ]


def test_defaults_strip_and_unknown_fields(spark):
    r = record("\t R9 \n", " 2026-10-08T12:00:00Z ", extra={"a": 1})
    del r["status"], r["active_fault"]
    got = accepted(label(parse_lines(raw(spark, [json.dumps(r)])))).first()
    assert (got.router_id, got.timestamp, got.status, got.active_fault) == (
        "R9", "2026-10-08T12:00:00Z", "ACTIVE", None,
    )


def test_first_broken_field_decides(spark):
    r = record(latency=-1.0, cpu_usage=200.0)
    del r["jitter"]
    assert verdicts(spark, [json.dumps(r)]) == ["latency: below_minimum"]


def test_duplicate_key_last_wins(spark):
    text = line(latency=-77.5).replace('"latency": -77.5', '"latency": 1.0, "latency": 2.0')
    assert label(parse_lines(raw(spark, [text]))).first().latency == 2.0


def test_times(spark):
    times = ["2026-10-08T12:00:00Z", "2026-10-08T12:00:00.000Z", "2026-10-08T12:00:00+00:00", "soon"]
    df = label(parse_lines(raw(spark, [line(timestamp=t) for t in times])))
    got = [r.event_time for r in df.orderBy("src_pos").collect()]
    assert len(set(got[:3])) == 1 and got[3] is None
    reasons = [r.reject_reason for r in strict_times(df).orderBy("src_pos").collect()]
    assert reasons == [None, None, None, "timestamp: not_a_time"]


def test_validate_splits_every_line(spark):
    valid, rejects = validate(parse_lines(raw(spark, [line(), "{", line(latency=-1)])))
    assert valid.count() == 1 and rejects.count() == 2
    assert rejected(label(parse_lines(raw(spark, ["{"])))).first().value == "{"


def test_canonical_record(spark):
    lines = [line(timestamp="2026-10-08T12:00:00+00:00", latency=1.005, packet_loss=2.675, cpu_usage=0.25)]
    got = canonicalize(accepted(label(parse_lines(raw(spark, lines))))).first()
    assert got.timestamp == "2026-10-08T12:00:00.000Z"
    assert (got.latency, got.packet_loss, got.cpu_usage) == (1.01, 2.68, 0.3)
    assert tuple(got.asDict()) == RECORD_FIELDS


def test_huge_numbers_survive_rounding(spark):
    got = canonicalize(accepted(label(parse_lines(raw(spark, [line(latency=1e300)]))))).first()
    assert got.latency == 1e300


def test_first_arrival_keeps_the_first_payload(spark):
    rows = accepted(label(parse_lines(raw(spark, [line(latency=i) for i in (3.0, 1.0, 2.0)]))))
    assert [r.latency for r in first_arrival(rows.repartition(3)).collect()] == [3.0]


def test_plain_and_other_lines_are_read_alike(spark):
    """A line as the writer leaves it takes the typed way, the same record with more space around its parts the other."""
    records = [
        record(), record(latency=-5.0), record(packet_loss=105.0), record("   "), record("R" * 65), record(timestamp=" "), record(cpu_usage=1e-7),
        record(latency=1e300), record(latency=12345678901234567890.0), record(active_fault="High Jitter", status="FAULTED"), record(status=""),
        record("Ré"), record("a\\b"), record('q"uote'), record(jitter=0.1 + 0.2), record(memory_usage=100), record(latency=0),
    ]
    plain = label(parse_lines(raw(spark, [json.dumps(r, ensure_ascii=False) for r in records]))).orderBy("src_pos")
    other = label(parse_lines(raw(spark, [json.dumps(r, indent=1).replace("\n", " ") for r in records]))).orderBy("src_pos")
    columns = [c for c in plain.columns if c != "value"]
    assert plain.select(columns).collect() == other.select(columns).collect()
    typed = parse_lines(raw(spark, [json.dumps(records[0]), json.dumps(records[0], indent=1).replace("\n", " "), line(latency="7")])).orderBy("src_pos")
    assert [r.typed is not None for r in typed.collect()] == [True, False, False]
