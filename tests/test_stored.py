"""Access paths of the stored table: what is opened, what is read, and that the results are whole."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkpulse.operators import select
from linkpulse.operators.ingest import accepted, label, parse_lines
from linkpulse.sources import footers as footer_facts
from linkpulse.sources import table as stored
from linkpulse.sources.footers import date_folders, footers
from linkpulse.sources.table import append_new, largest_id, newest_stored, read_telemetry, time_spans, written
from linkpulse.streaming.ingest import with_arrival_id
from tests.helpers import line, raw

FIRST = datetime(2026, 10, 1)


def stamp(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def batch(spark, lines, first_id=1):
    return with_arrival_id(accepted(label(parse_lines(raw(spark, lines)))), first_id)


@pytest.fixture(scope="module")
def ten_days(spark, tmp_path_factory):
    """Ten days with 24 records each of 6 routers; one router only on days 2 and 5; two records without a time."""
    path = str(tmp_path_factory.mktemp("stored") / "table")
    lines = [line(f"R{h % 6}", stamp(FIRST + timedelta(days=d, hours=h))) for d in range(10) for h in range(24)]
    lines += [line("RARE", stamp(FIRST + timedelta(days=d, minutes=7))) for d in (2, 5)] + [line("R1", "junk"), line("R2", "later")]
    assert append_new(batch(spark, lines), path, "first") == 244
    return path


def opened(df) -> set[str]:
    """Dates of the files that a result reads."""
    return {f.split("event_date=")[1].split("/")[0] for f in df.inputFiles()}


def rows_scanned(df) -> int:
    """Rows that the scans of a collected result put out."""
    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        found = plan.collectLeaves()
        for leaf in (found.apply(i) for i in range(found.size())):
            yield from leaves(leaf.plan()) if "QueryStage" in leaf.getClass().getSimpleName() else [leaf]

    scans = [x for x in leaves(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "FileSourceScanExec"]
    assert scans
    return sum(x.metrics().get("numOutputRows").get().value() for x in scans)


def same(got, want):
    key = lambda df: [(r.id, r.router_id, r.timestamp) for r in df.collect()]
    assert key(got) == key(want)


def test_newest_from_footers(spark, ten_days):
    table = read_telemetry(spark, ten_days)
    for n in (1, 5, 24, 25, 60, 242, 300):
        same(newest_stored(spark, ten_days, n), select.latest(table, n))
    assert opened(newest_stored(spark, ten_days, 5)) == {"2026-10-10"}
    assert opened(newest_stored(spark, ten_days, 30)) == {"2026-10-10", "2026-10-09", "2026-10-08"}
    as_of = "2026-10-09 12:00:00"
    got = newest_stored(spark, ten_days, 100, minutes=1440, as_of=as_of)
    same(got, select.recent(table, minutes=1440, n=100, as_of=as_of))
    assert opened(got) <= {"2026-10-10", "2026-10-09", "2026-10-08"}


def test_history_reads_newest_dates_first(spark, ten_days):
    table = read_telemetry(spark, ten_days)
    got = newest_stored(spark, ten_days, 3, router_id="R3")
    same(got, select.router_history(table, "R3", 3))
    assert opened(got) == {"2026-10-10"}
    got = newest_stored(spark, ten_days, 10, router_id=" R3 ")
    same(got, select.router_history(table, "R3", 10))
    assert opened(got) == {"2026-10-10", "2026-10-09", "2026-10-08"}
    # found in few places, or nowhere: all dates are asked, but rows of two are read
    got = newest_stored(spark, ten_days, 3, router_id="RARE")
    same(got, select.router_history(table, "RARE", 3))
    assert got.count() == 2
    nowhere = newest_stored(spark, ten_days, 3, router_id="R2x")  # within the routers' order, so bounds do not tell
    assert nowhere.collect() == [] and rows_scanned(nowhere) == 0
    as_of = "2026-10-10 12:00:00"
    got = newest_stored(spark, ten_days, 9, router_id="R3", minutes=600, as_of=as_of)
    same(got, select.recent(table, minutes=600, router_id="R3", n=9, as_of=as_of))
    assert 0 < got.count() < 9


def test_footers_agree_with_rows(spark, ten_days):
    folders = [f for _, f in date_folders(spark, ten_days)]
    names = ("event_date", "rows", "low", "high", "first_ingest", "last_ingest", "max_id")
    got = footers(spark, ten_days, folders)
    scanned = footer_facts._scanned(spark, ten_days, folders)
    each = lambda df: sorted(map(str, df.groupBy("event_date", "first_ingest", "last_ingest").agg(F.sum("rows"), F.min("low"), F.max("high"), F.max("max_id")).collect()))
    assert set(names) <= set(got.columns) and each(got) == each(scanned)
    assert largest_id(spark, ten_days, "none") == 244 and largest_id(spark, ten_days, "first") == 0


def test_late_record_widens_no_lookup(spark, ten_days, tmp_path, monkeypatch):
    path = str(tmp_path / "copy")
    append_new(read_telemetry(spark, ten_days).drop("event_date", "imported_at", "ingest_id"), path, "old")
    seen = []
    records = stored._Touched.records
    monkeypatch.setattr(stored._Touched, "records", lambda self: seen.append(records(self)) or seen[-1])
    late = [line("R9", stamp(FIRST + timedelta(hours=3))), line("R0", stamp(FIRST + timedelta(days=9, hours=18))), line("R9", stamp(FIRST + timedelta(days=9, hours=20)))]
    assert append_new(batch(spark, late, 1000), path, "late") == 2
    assert opened(seen[0]) == {"2026-10-01", "2026-10-10"}
    assert seen[0].count() == 3  # records within the three spans of time, of an hour each
    assert read_telemetry(spark, path).count() == 246
    # the same batch again, under the same name and under another one
    assert append_new(batch(spark, late, 1000), path, "late") == 2
    assert append_new(batch(spark, late, 1000), path, "again") == 0
    assert written(spark, path, "late") == 2 and written(spark, path, "old") == 244 and written(spark, path, "nobody") == 0


def test_spans_close_the_smallest_gaps(spark):
    hours = [0, 1, 2, 10, 50, 51, 200]
    rows = [(FIRST + timedelta(hours=h, minutes=30),) for h in hours] + [(None,)]
    df = spark.createDataFrame(rows, "event_time timestamp_ntz").withColumn("event_time", F.col("event_time").cast("timestamp"))
    zero = int((FIRST - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + 1_800_000_000
    spans = lambda most: ([((a - zero) / 3.6e9, (b - zero) / 3.6e9) for a, b in time_spans(df, most)[0]])
    assert spans(64) == [(0, 2), (10, 10), (50, 51), (200, 200)]
    assert spans(3) == [(0, 10), (50, 51), (200, 200)] and spans(1) == [(0, 200)]
    assert time_spans(df)[1] and time_spans(df.filter("event_time IS NULL")) == ([], True)
    assert time_spans(df.limit(0)) == ([], False)


def test_mixed_files_are_counted_by_rows(spark, ten_days, tmp_path):
    path = str(tmp_path / "mixed")
    table = read_telemetry(spark, ten_days).withColumn("ingest_id", F.when(F.col("id") % 4 == 0, "b").otherwise("a"))
    table.coalesce(1).write.partitionBy("event_date").parquet(path)
    assert written(spark, path, "a") == table.filter("ingest_id = 'a'").count()
    assert written(spark, path, "c") == 0


def test_no_table_yet(spark, tmp_path):
    path = str(tmp_path / "none")
    assert newest_stored(spark, path, 3).collect() == [] and newest_stored(spark, path, 3, router_id="R1").collect() == []
    assert largest_id(spark, path, "x") == 0 and written(spark, path, "x") == 0 and date_folders(spark, path) == []


def test_statistics_from_partials(spark, ten_days, tmp_path):
    from linkpulse.operators import stats
    from linkpulse.sources.partials import DailyPartials

    path, as_of = str(tmp_path / "copy"), "2026-10-09 12:00:00"
    append_new(read_telemetry(spark, ten_days).drop("event_date", "imported_at", "ingest_id"), path, "old")
    partials = DailyPartials(spark, path, str(tmp_path / "partials"))
    text = lambda df: sorted(str(r) for r in df.collect())

    def check():
        table = read_telemetry(spark, path)
        for minutes in (None, 3 * 1440 + 600):
            assert text(partials.stats(minutes, as_of)) == text(stats.stats(table, minutes, as_of))
        assert text(partials.router_stats()) == text(stats.router_stats(table))

    check()  # nothing stored yet: all from the records
    assert partials.refresh() == 11 and partials.refresh() == 0
    check()
    # whole days come from the partials: only the first day's records are opened, and no stale ones
    got = partials.stats(3 * 1440 + 600, as_of)
    assert {f for f in got.inputFiles() if "/copy/" in f} == {f for f in got.inputFiles() if "event_date=2026-10-06" in f and "/copy/" in f}
    assert append_new(batch(spark, [line("R8", stamp(FIRST + timedelta(days=7, minutes=1)))], 900), path, "late") == 1
    assert [str(d) for d, _ in partials.stale()] == ["2026-10-08"]
    check()
    assert partials.refresh() == 1
    check()
    assert partials.stats(list_routers=False).first().routers is None


def test_snapshot_of_latest_states(spark, tmp_path):
    from linkpulse.operators.registry import router_states
    from linkpulse.streaming.ingest import IngestSink, ingest_batch
    from linkpulse.streaming.states import LatestStates

    sink = IngestSink(str(tmp_path / "table"), None, str(tmp_path / "ledger"), states=str(tmp_path / "states"))
    states = LatestStates(spark, sink.states)
    assert states.states().collect() == []

    def check():
        assert list(map(str, states.states().collect())) == list(map(str, router_states(read_telemetry(spark, sink.table)).collect()))

    def ingest(lines, run, number=0):
        ingest_batch(raw(spark, lines), sink, run, number)
        check()

    first = [line(f"R{i % 4}", stamp(FIRST + timedelta(minutes=i))) for i in range(20)]
    ingest(first, "a")
    ingest(first[:5] + [line("R1", stamp(FIRST - timedelta(days=3)), latency=1.0), line("R9", "junk")], "b")  # repeated, late, without a time
    ingest([line("R2", stamp(FIRST + timedelta(days=1)), latency=2.0)], "a", 1)
    ingest([line("R2", stamp(FIRST + timedelta(days=1)), latency=2.0)], "a", 1)  # replayed
    own = read_telemetry(spark, sink.table).filter("ingest_id = 'a/1'")
    assert own.count() == 1 and not states.apply(own, "a", 1)
    # a snapshot without its mark does not count
    read_telemetry(spark, sink.table).limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{sink.states}/snapshot=99")
    check()


def test_closed_days_are_rolled_up(spark, tmp_path, monkeypatch):
    from datetime import date

    from linkpulse.operators.ledger import ingest_status
    from linkpulse.schema import STORED_LEDGER_SCHEMA
    from linkpulse.streaming import rollup
    from linkpulse.streaming.ingest import IngestSink, read_ledger, read_rejects, roll_up_closed_days
    from linkpulse.schema import REJECT_SCHEMA

    monkeypatch.setattr(rollup, "MERGE", 3)
    sink = IngestSink(str(tmp_path / "t"), str(tmp_path / "rejects"), str(tmp_path / "ledger"))

    def batches(first, n, day):
        ids = spark.range(first, first + n)
        name = F.concat(F.lit("q/"), F.col("id"))
        ledger = ids.select(name.alias("ingest_id"), F.col("id").alias("batch_id"), F.lit(5).cast("long").alias("lines_read"), F.lit(3).cast("long").alias("inserted"), F.lit(2).cast("long").alias("errors"),
                            F.lit(f"{day} 10:00:00").cast("timestamp").alias("polled_at"), F.lit("e").alias("last_error"), F.lit("t").alias("last_imported_timestamp"), F.col("id").alias("last_id"))
        rejects = ids.select(F.lit("v").alias("value"), F.lit("f").alias("src_file"), F.struct(F.col("id").alias("block"), F.lit(0).cast("long").alias("row")).alias("src_pos"), F.lit("r").alias("reject_reason"), name.alias("ingest_id"))
        for df, schema, to in ((ledger, STORED_LEDGER_SCHEMA, sink.ledger), (rejects, REJECT_SCHEMA, sink.rejects)):
            own = df.select(*schema.names).withColumns({"run": F.lit("q"), "batch": F.substring_index("ingest_id", "/", -1)})
            own.coalesce(1).write.mode("append").partitionBy("run", "batch").parquet(to)

    def count():
        status = ingest_status(read_ledger(spark, sink.ledger)).first()
        return status.batches, status.total_lines_read, read_rejects(spark, sink.rejects).count(), read_ledger(spark, sink.ledger).count()

    batches(0, 100, "2026-10-01")
    batches(100, 20, "2026-10-02")
    assert count() == (120, 600, 120, 120)
    # interrupted before the mark: the generation does not count, and is written anew
    read_ledger(spark, sink.ledger).limit(7).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{sink.ledger}/rolled/gen=1-1")
    assert count() == (120, 600, 120, 120)
    # interrupted after the mark: batches are there twice, and count once
    kept = []
    monkeypatch.setattr(rollup, "remove", lambda s, p: kept.append(p) if "/batch=" in p else None)
    roll_up_closed_days(spark, sink, date(2026, 10, 2))
    assert len(kept) == 200 and count() == (120, 600, 120, 120)
    monkeypatch.undo()
    monkeypatch.setattr(rollup, "MERGE", 3)
    assert roll_up_closed_days(spark, sink, date(2026, 10, 2)) == 200
    assert len(rollup.open_batches(spark, sink.ledger)) == 20 and count() == (120, 600, 120, 120)
    for i in range(3):  # many generations become one
        batches(200 + 3 * i, 3, "2026-10-03")
        roll_up_closed_days(spark, sink, date(2026, 10, 4))
    assert len(rollup.generations(spark, sink.ledger)) < 3 and rollup.open_batches(spark, sink.ledger) == []
    assert count() == (129, 645, 129, 129)
