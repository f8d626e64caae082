from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from linkpulse.operators import select, stats
from linkpulse.operators.ingest import accepted, label, parse_lines
from linkpulse.schema import RECORD_SCHEMA
from linkpulse.sources.log import log_stats, log_tail, read_log, reset_log, stream_log, tail_log, write_log
from linkpulse.sources.table import append_new, read_telemetry, table_metadata, write_rejects
from linkpulse.streaming.ingest import (
    IngestSink, ingest_batch, ingest_once, ingest_report, read_ledger, read_rejects, start_ingest,
    with_arrival_id,
)
from tests.helpers import line, raw, record


class Site:
    """A log, the sink fed from it and a checkpoint, all in one folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.log = folder / "telemetry.jsonl"
        self.restart()

    def restart(self):
        self.sink = IngestSink(*(str(self.folder / n) for n in ("table", "rejects", "ledger")))

    def write(self, *lines, mode="w", end="\n"):
        with open(self.log, mode, encoding="utf-8") as f:
            f.write("\n".join(lines) + end)

    def cycle(self, repeat=True, **options):
        lines = tail_log(self.spark, str(self.log), **options)
        return ingest_once(lines, self.sink, str(self.folder / "checkpoint"), repeat)

    def table(self):
        return read_telemetry(self.spark, self.sink.table)


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def outcome(report):
    return tuple(report[k] for k in ("status", "lines_read", "records_inserted", "errors"))


def at(second, router="R1", **changes):
    return line(router, f"2026-10-08T12:00:{second:02d}Z", **changes)


def test_incremental_cycles(site):
    assert outcome(site.cycle()) == ("waiting_for_file", 0, 0, 0)
    site.write(*[at(s, r) for s in (11, 42) for r in ("R1", "R2")])
    assert outcome(site.cycle()) == ("success", 4, 4, 0)
    assert outcome(site.cycle()) == ("up_to_date", 0, 0, 0)
    site.write(at(43, "R3"), at(44, "R3"), mode="a")
    site.restart()
    assert outcome(site.cycle()) == ("success", 2, 2, 0)
    facts = table_metadata(site.spark, site.sink.table).first()
    assert (facts.total_records, facts.router_count) == (6, 3)
    assert facts.files > 0 and facts.size_bytes > 0
    ids = [r.id for r in site.table().orderBy("event_time", "router_id").collect()]
    assert ids == sorted(ids) or len(set(ids)) == 6
    report = ingest_report(site.spark, site.sink).first()
    assert (report.total_lines_read, report.total_records_inserted, report.total_records) == (6, 6, 6)


def test_malformed_lines_and_blank_lines(site):
    site.write(at(1), at(5)[:-9], '{"router_id": "R1"}', "", "[1]", at(2))
    assert outcome(site.cycle()) == ("success", 6, 2, 3)
    reasons = {r.reject_reason for r in read_rejects(site.spark, site.sink.rejects).collect()}
    assert reasons == {"JSONDecodeError", "timestamp: missing", "not_object"}
    ledger = read_ledger(site.spark, site.sink.ledger).orderBy(F.col("batch_id").desc()).first()
    assert ledger.last_error == "not_object" and ledger.last_imported_timestamp == "2026-10-08T12:00:02Z"


def test_truncation_and_replacement(site):
    site.write(at(1), at(2), at(3))
    assert outcome(site.cycle())[2] == 3
    site.write(at(9))
    assert outcome(site.cycle()) == ("success", 1, 1, 0)
    assert site.table().count() == 4
    # A larger file in its place is noticed as well.
    site.write(*[at(s, "R7") for s in range(20)])
    assert outcome(site.cycle()) == ("success", 20, 20, 0)
    site.log.unlink()
    assert outcome(site.cycle())[0] == "waiting_for_file"


def test_torn_last_line_waits(site):
    whole = at(2)
    site.write(at(1), whole[:30], end="")
    assert outcome(site.cycle()) == ("success", 1, 1, 0)
    site.write(whole[30:], mode="a")
    assert outcome(site.cycle()) == ("success", 1, 1, 0)


def test_many_ranges_and_bounded_batches(site):
    lines = [at(s % 60, f"R{s}") for s in range(500)]
    site.write(*lines[:10])
    site.cycle(split_bytes=100)
    site.write(*lines[10:], mode="a")
    report = site.cycle(split_bytes=997, max_bytes_per_batch=20_000)
    assert outcome(report) == ("success", 490, 490, 0)
    ids = [r.id for r in site.table().orderBy(F.substring("router_id", 2, 9).cast("int")).collect()]
    assert len(set(ids)) == 500 and ids == sorted(ids)


def test_bad_bytes_are_replaced(site):
    site.log.write_bytes(at(1).replace("R1", "R\xff").encode("latin-1") + b"\r\n")
    assert outcome(site.cycle()) == ("success", 1, 1, 0)
    assert site.table().first().router_id == "R�"


def test_duplicates_and_late_rows(site):
    site.write(at(30, latency=1.0), at(30, latency=2.0), at(31))
    assert outcome(site.cycle()) == ("success", 3, 2, 0)
    site.write(at(30, latency=3.0), line("R1", "2020-01-01T00:00:00Z"), line("R1", "someday"),
               line("R1", "someday"), mode="a")
    assert outcome(site.cycle()) == ("success", 4, 2, 0)
    kept = site.table().filter("timestamp = '2026-10-08T12:00:30Z'").collect()
    assert [r.latency for r in kept] == [1.0]
    site.write(line("R1", "someday"), mode="a")
    assert outcome(site.cycle()) == ("success", 1, 0, 0)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("table", "rejects", "ledger")]
    lines = raw(spark, [at(1), at(2), "{", at(2)])
    for _ in range(2):
        # A new sink stands for a restart; the first try got as far as the ledger.
        ingest_batch(lines, IngestSink(*paths), "run-7", 7)
    assert read_telemetry(spark, paths[0]).count() == 2
    assert read_rejects(spark, paths[1]).count() == 1
    ledger = read_ledger(spark, paths[2]).collect()
    assert [(r.lines_read, r.inserted, r.errors) for r in ledger] == [(4, 2, 1)]
    ids = {r.id for r in read_telemetry(spark, paths[0]).collect()}
    assert ids == {1, 2}


def test_append_new_counts_and_keys(spark, tmp_path):
    def batch(*lines):
        return with_arrival_id(accepted(label(parse_lines(raw(spark, lines)))), 1)

    path = str(tmp_path / "t")
    assert append_new(batch(at(0), at(1)), path) == 2
    assert append_new(batch(at(1), at(0), at(2)), path) == 1
    assert append_new(batch(at(1)), path) == 0
    # The same instant in another spelling is another record, unless asked otherwise.
    other = line(timestamp="2026-10-08T12:00:00.000Z")
    assert append_new(batch(other), path, key="event_time") == 0
    assert append_new(batch(other), path) == 1
    with pytest.raises(ValueError):
        append_new(batch(other), path, key="latency")


def test_many_dates(spark, tmp_path):
    days = [line(timestamp=f"2026-10-0{d}T00:00:00Z") for d in range(1, 6)] + [line(timestamp="x")]
    batch = with_arrival_id(accepted(label(parse_lines(raw(spark, days)))), 1)
    path = str(tmp_path / "t")
    assert append_new(batch, path) == 6
    assert append_new(batch, path) == 0


def test_stored_dates_are_pruned(spark, tmp_path):
    days = [line(timestamp=f"2026-10-0{d}T00:00:00Z") for d in range(1, 6)]
    path = str(tmp_path / "t")
    append_new(with_arrival_id(accepted(label(parse_lines(raw(spark, days)))), 1), path)
    table = read_telemetry(spark, path)
    for df in (select.recent(table, minutes=60, as_of="2026-10-05 00:30:00"), select.latest(table, 2), stats.stats(table, minutes=60, as_of="2026-10-05 00:30:00")):
        filters = [x for x in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:] if not x.startswith("[]")]
        assert any("event_date" in x.split("]")[0] for x in filters)
    assert select.recent(table, minutes=60, as_of="2026-10-05 00:30:00").count() == 1
    assert [r.timestamp[:10] for r in select.latest(table, 2).collect()] == ["2026-10-05", "2026-10-04"]


def test_batch_runs_are_apart(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("table", "rejects", "ledger")]
    assert read_rejects(spark, paths[1]).count() == 0
    for lines in ([at(1), "{broken"], [at(2), "[]"]):
        ingest_batch(raw(spark, lines), IngestSink(*paths))
    assert {r.id for r in read_telemetry(spark, paths[0]).collect()} == {1, 2}
    assert {r.value for r in read_rejects(spark, paths[1]).collect()} == {"{broken", "[]"}
    assert sorted((r.lines_read, r.inserted, r.errors) for r in read_ledger(spark, paths[2]).collect()) == [(2, 1, 1)] * 2


def test_log_replaced_under_an_equal_beginning(site):
    same = [at(s % 60, f"R{s}") for s in range(60)]
    site.write(*same, *[at(1, f"A{s}") for s in range(40)])
    site.cycle()
    # As long as before, the same first bytes, other lines after them.
    site.write(*same, *[at(1, f"B{s}") for s in range(60)])
    assert outcome(site.cycle()) == ("success", 120, 60, 0)
    assert site.table().filter("router_id like 'B%'").count() == 60


def test_first_batch_of_a_backlog_is_bounded(site):
    site.write(*[at(s % 60, f"R{s}") for s in range(300)])
    size = site.log.stat().st_size // 300
    assert 25 <= site.cycle(repeat=False, max_bytes_per_batch=30 * size)["lines_read"] <= 32
    site.restart()
    assert outcome(site.cycle(max_bytes_per_batch=100 * size))[0] == "success"
    assert site.table().count() == 300
    assert max(r.lines_read for r in read_ledger(site.spark, site.sink.ledger).collect()) <= 102


def test_failed_cycle_is_counted(site):
    site.write(at(1))
    site.sink.key = "latency"
    assert site.cycle()["status"] == "error"
    row = ingest_report(site.spark, site.sink).first()
    assert row.last_error


def test_part_file_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    sink = IngestSink(*(str(tmp_path / n) for n in ("table", "rejects", "ledger")))
    check = str(tmp_path / "c")
    assert stream_log(spark, str(folder)) is None
    folder.mkdir()
    (folder / "a.jsonl").write_text(at(1) + "\n" + at(2) + "\n")
    (folder / "b.jsonl").write_text(at(2) + "\n" + at(3) + "\n")
    assert outcome(ingest_once(stream_log(spark, str(folder), 1), sink, check)) == ("success", 4, 3, 0)
    (folder / "c.jsonl").write_text(at(4) + "\n")
    assert outcome(ingest_once(stream_log(spark, str(folder)), sink, check)) == ("success", 1, 1, 0)


def test_continuous_run(site):
    site.write(at(1))
    query = start_ingest(tail_log(site.spark, str(site.log)), site.sink, str(site.folder / "c"))
    try:
        query.processAllAvailable()
        site.write(at(2), mode="a")
        query.processAllAvailable()
        assert site.table().count() == 2
        assert ingest_report(site.spark, site.sink, query).first().running
    finally:
        query.stop()


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([record("R1"), record("R2", active_fault="High Jitter")], RECORD_SCHEMA)
    write_log(rows.coalesce(1), path)
    write_log(rows.coalesce(1), path)
    first = json.loads(read_log(spark, path).first().value)
    assert first == record("R1")
    stats = log_stats(spark, path).first()
    assert (stats.total_records, stats.files) == (4, 2)
    assert stats.size_kb == round(stats.size_bytes / 1024, 2)
    reset_log(spark, path)
    assert read_log(spark, path).count() == 0
    write_rejects(raw(spark, ["{"]), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_log_tail_order(spark, tmp_path):
    lines = [at(s % 60, f"R{s}") for s in range(200)]
    (tmp_path / "l.jsonl").write_text("\n".join(lines[:150] + ["{broken", ""] + lines[150:]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        raw_lines = read_log(spark, str(tmp_path / "l.jsonl"))
        assert raw_lines.rdd.getNumPartitions() > 5
        got = [json.loads(r.value)["router_id"] for r in log_tail(raw_lines, 60).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [f"R{s}" for s in range(140, 200)]


def test_log_replaced_in_the_middle(site, monkeypatch):
    """Both ends equal, the middle another one: the digests of the blocks tell."""
    from linkpulse.sources import jsonl_tail

    monkeypatch.setattr(jsonl_tail, "BLOCK_BYTES", 2048)
    monkeypatch.setattr(jsonl_tail, "FINGERPRINT_BYTES", 256)
    marks = str(site.folder / "marks")
    lines = [at(s, f"R{s}") for s in range(60)]
    site.write(*lines)
    assert outcome(site.cycle(marks=marks, split_bytes=5000))[2] == 60
    assert outcome(site.cycle(marks=marks)) == ("up_to_date", 0, 0, 0)
    site.write(*[at(s + 1, f"Q{s}") if 25 <= s < 35 else text for s, text in enumerate(lines)])
    found = [outcome(site.cycle(marks=marks, split_bytes=5000)) for _ in range(4)]
    assert sum(f[2] for f in found) == 10 and site.table().count() == 70
    site.write(at(59, "R77"), mode="a")
    assert outcome(site.cycle(marks=marks)) == ("success", 1, 1, 0)


def test_cycle_counts_all_batches(site, monkeypatch):
    """More batches than the stream keeps reports of."""
    folder = site.folder / "parts"
    folder.mkdir()
    for i in range(7):
        (folder / f"part-{i}.jsonl").write_text(at(i, f"R{i}") + "\n")
    site.spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        report = ingest_once(stream_log(site.spark, str(folder), 1), site.sink, str(site.folder / "checkpoint"))
    finally:
        site.spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert outcome(report) == ("success", 7, 7, 0)


def test_tail_from_the_end(spark, tmp_path):
    from linkpulse.sources.log import log_tail_file

    path = tmp_path / "log.jsonl"
    lines = [at(i % 60, f"R{i}") if i % 3 else "junk" for i in range(3000)]
    path.write_text("\n".join(lines) + "\n")
    for n, block in ((1, 300), (50, 1000), (5000, 1000)):
        got = log_tail_file(spark, str(path), n, block)
        assert [r.value for r in got.collect()] == [x for x in lines if x != "junk"][-n:]
    # fifty lines of a long log: a few blocks from its end
    few = log_tail_file(spark, str(path), 50, 4000)
    assert min(r.src_pos.block for r in few.collect()) > path.stat().st_size - 40_000
    parts = tmp_path / "parts"
    parts.mkdir()
    for i in range(5):
        (parts / f"part-{i}").write_text("\n".join(lines[600 * i : 600 * (i + 1)]) + "\n")
    assert [r.value for r in log_tail_file(spark, str(parts), 700, 2000).collect()] == [x for x in lines if x != "junk"][-700:]
    assert log_tail_file(spark, str(tmp_path / "none")).collect() == []
