"""Network statistics. Every aggregate is reduced on the map side first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mean_dp, round_dp
from ..schema import METRICS
from .select import faulted_records, in_window


def summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Row count, router count, first and last time: one row."""
    routers = (
        F.approx_count_distinct("router_id") if approx else F.count_distinct("router_id")
    )
    return df.agg(
        F.count("*").alias("total_records"),
        routers.alias("router_count"),
        F.min("event_time").alias("earliest"),
        F.max("event_time").alias("latest"),
    )


def _metric_columns(prefix_to: dict[str, Column]) -> Column:
    """Turn wide metric columns into rows `(metric, min, max, avg)`."""
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    *[c(m).alias(k) for k, c in prefix_to.items()],
                )
                for m in METRICS
            ]
        )
    )


def metric_stats(df: DataFrame) -> DataFrame:
    """Min, max and average of each metric, rounded; zeros for an empty input.

    One wide aggregate, turned into six rows afterwards.
    """
    zero = F.lit(0.0)
    wide = df.agg(
        *[
            e
            for m in METRICS
            for e in (
                F.coalesce(round_dp(F.min(m), 2), zero).alias(f"min_{m}"),
                F.coalesce(round_dp(F.max(m), 2), zero).alias(f"max_{m}"),
                F.coalesce(mean_dp(m), zero).alias(f"avg_{m}"),
            )
        ]
    )
    return wide.select(
        _metric_columns({k: (lambda m, k=k: F.col(f"{k}_{m}")) for k in ("min", "max", "avg")})
    )


def status_distribution(df: DataFrame) -> DataFrame:
    """Rows per status."""
    return df.groupBy("status").agg(F.count("*").alias("records"))


def fault_distribution(df: DataFrame) -> DataFrame:
    """Rows per named fault."""
    return faulted_records(df).groupBy("active_fault").agg(F.count("*").alias("records"))


def sample_counts(df: DataFrame) -> DataFrame:
    """Rows per router."""
    return df.groupBy("router_id").agg(F.count("*").alias("sample_count"))


def routers(df: DataFrame) -> DataFrame:
    """The distinct router ids in text order."""
    return df.select("router_id").distinct().orderBy("router_id")


def fine_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts, bounds and sums by `keys` and (router, status, fault): small rows that add up to any statistics."""
    return df.groupBy(*keys, "router_id", "status", "active_fault").agg(
        F.count("*").alias("records"),
        F.min("event_time").alias("earliest"),
        F.max("event_time").alias("latest"),
        *[F.min(m).alias(f"min_{m}") for m in METRICS],
        *[F.max(m).alias(f"max_{m}") for m in METRICS],
        *[F.sum(m).alias(f"sum_{m}") for m in METRICS],
    )


def stats_parts(
    df: DataFrame, minutes: int | None = None, as_of: datetime | str | None = None
) -> DataFrame:
    """All parts of the statistics in tall form, from a single scan.

    The table is first reduced to one row per (router, status, fault); only that result is grouped four ways.
    """
    return parts_of(fine_parts(in_window(df, minutes, as_of)))


def parts_of(fine: DataFrame) -> DataFrame:
    """All parts of the statistics in tall form, from rows of `fine_parts`.

    Rows are `(part, key, records, earliest, latest, min_*, max_*, sum_*)` with `part`
    one of total, status, fault, router.
    """
    keys = ("router_id", "status", "active_fault")
    sets = [[], [F.col("status")], [F.col("active_fault")], [F.col("router_id")]]
    # grouping_id has one bit per key, set where the key is rolled up.
    parts = {7: "total", 5: "status", 6: "fault", 3: "router"}
    part = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.lit(v))])
    grouped = fine.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("gid"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.min("earliest").alias("earliest"),
        F.max("latest").alias("latest"),
        *[F.min(f"min_{m}").alias(f"min_{m}") for m in METRICS],
        *[F.max(f"max_{m}").alias(f"max_{m}") for m in METRICS],
        *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in METRICS],
    )
    tall = grouped.withColumns(
        {
            "part": part[F.col("gid").cast("int")],
            "key": F.coalesce("status", "active_fault", "router_id"),
        }
    ).drop("gid", *keys)
    return tall.filter(F.col("key").isNotNull() | (F.col("part") == "total"))


def stats(
    df: DataFrame, minutes: int | None = None, as_of: datetime | str | None = None, list_routers: bool = True
) -> DataFrame:
    """The statistics document: always exactly one row.

    Holds a list of all routers, unless `list_routers` is false: for networks too large to list in one value.
    """
    return document(stats_parts(df, minutes, as_of), minutes, list_routers)


def document(parts: DataFrame, minutes: int | None = None, list_routers: bool = True) -> DataFrame:
    """The statistics document of the rows of `parts_of`."""
    is_part = {p: F.col("part") == p for p in ("total", "status", "fault", "router")}

    def total(name: str) -> Column:
        return F.max(F.when(is_part["total"], F.col(name)))

    def counts(name: str) -> Column:
        pairs = F.collect_list(
            F.when(is_part[name], F.struct("key", "records"))
        )
        return F.map_from_entries(F.array_sort(pairs))

    zero, records = F.lit(0.0), F.coalesce(total("records"), F.lit(0))
    metrics = F.map_from_entries(
        F.array(
            *[
                F.struct(
                    F.lit(m),
                    F.struct(
                        F.coalesce(round_dp(total(f"min_{m}"), 2), zero).alias("min"),
                        F.coalesce(round_dp(total(f"max_{m}"), 2), zero).alias("max"),
                        F.coalesce(
                            round_dp(total(f"sum_{m}") / F.nullif(records, F.lit(0)), 2), zero
                        ).alias("avg"),
                    ),
                )
                for m in METRICS
            ]
        )
    )
    routers = F.collect_list(F.when(is_part["router"], F.col("key"))) if list_routers else F.lit(None).cast("array<string>")
    router_list = F.array_sort(routers)
    return parts.agg(
        records.alias("total_records"),
        F.count_if(is_part["router"]).alias("router_count"),
        router_list.alias("routers"),
        total("earliest").alias("earliest"),
        total("latest").alias("latest"),
        F.lit(minutes).cast("int").alias("time_window_minutes"),
        metrics.alias("metrics"),
        counts("status").alias("status_distribution"),
        counts("fault").alias("fault_distribution"),
    )


def stats_table(
    df: DataFrame, minutes: int | None = None, as_of: datetime | str | None = None
) -> DataFrame:
    """`stats_parts` finished: per part and key the count and each rounded metric."""
    zero = F.lit(0.0)
    finished = [
        c
        for m in METRICS
        for c in (
            F.coalesce(round_dp(F.col(f"min_{m}"), 2), zero).alias(f"min_{m}"),
            F.coalesce(round_dp(F.col(f"max_{m}"), 2), zero).alias(f"max_{m}"),
            F.coalesce(
                round_dp(F.col(f"sum_{m}") / F.nullif("records", F.lit(0)), 2), zero
            ).alias(f"avg_{m}"),
        )
    ]
    return stats_parts(df, minutes, as_of).select(
        "part", "key", "records", "earliest", "latest", *finished
    )


def router_stats(df: DataFrame) -> DataFrame:
    """Per-router statistics plus one row for the whole network (`router_id` NULL).

    The network row is built from the router rows, not from a second copy of the
    input rows.
    """
    return _router_rollup(
        df.groupBy("router_id").agg(
            F.count("*").alias("n"),
            *[e for m in METRICS for e in (
                F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"), F.sum(m).alias(f"s_{m}")
            )],
        )
    )


def router_stats_of(fine: DataFrame) -> DataFrame:
    """`router_stats` from rows of `fine_parts`."""
    return _router_rollup(
        fine.groupBy("router_id").agg(
            F.sum("records").alias("n"),
            *[e for m in METRICS for e in (
                F.min(f"min_{m}").alias(f"lo_{m}"), F.max(f"max_{m}").alias(f"hi_{m}"), F.sum(f"sum_{m}").alias(f"s_{m}")
            )],
        )
    )


def _router_rollup(per_router: DataFrame) -> DataFrame:
    rolled = per_router.rollup("router_id").agg(
        F.grouping("router_id").cast("int").alias("is_total"),
        F.sum("n").alias("sample_count"),
        *[
            e
            for m in METRICS
            for e in (
                round_dp(F.min(f"lo_{m}"), 2).alias(f"min_{m}"),
                round_dp(F.max(f"hi_{m}"), 2).alias(f"max_{m}"),
                round_dp(F.sum(f"s_{m}") / F.sum("n"), 2).alias(f"avg_{m}"),
            )
        ],
    )
    return rolled
