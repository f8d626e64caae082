"""From raw log lines to validated, canonical, deduplicated records."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso_text, parse_time, round_dp, strip
from ..schema import (
    CANONICAL_DIGITS,
    DEFAULT_STATUS,
    METRICS,
    PERCENT_METRICS,
    RECORD_FIELDS,
    RECORD_SCHEMA,
    ROUTER_ID_MAX_LENGTH,
)

BAD_JSON = "JSONDecodeError"
NOT_OBJECT = "not_object"
NON_FINITE = "non_finite"
BLANK = "blank"

# Marks the end of a line inside the parsed array, so that text after the JSON
# value cannot go unnoticed (the variant parser stops at the end of a value).
_END = "linkpulse:end-of-line"

_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NON_FINITE_TEXT = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"
# A bare NaN or Infinity where JSON expects a value.
_NON_FINITE_TOKEN = r"([:\[,]\s*)(?:NaN|-?Infinity)(?=\s*[,}\]])"




def _plain_line() -> str:
    """Pattern of a line as the log's writer leaves it: every field, in order, of its own kind, nothing escaped.

    What such a line holds is plain from its text, so that a typed parser cannot read it otherwise than the variant one.
    """
    text, number = r'"[^"\\\x00-\x1f]*"', r"-?(?:0|[1-9]\d{0,14})(?:\.\d{1,30})?(?:[eE][+-]?\d{1,3})?"
    kinds = {m: number for m in METRICS} | {"active_fault": f"(?:null|{text})"}
    fields = [f'"{f}": ?{kinds.get(f, text)}' for f in RECORD_FIELDS]
    return r"^\{" + ", ?".join(fields) + r"\}$"


_PLAIN = _plain_line()


def _parse(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Parse each line.

    Adds `typed`, the record fields of a line that is written plainly; for other lines `doc` (a VARIANT holding
    `[value, end mark]`); and `parse_reason`, which is NULL for a JSON object. Blank lines get the reason `blank`; they were read, but
    are no error. They are not filtered out here: the filter would be pushed below
    whatever makes the lines and have it done twice.
    """
    lines = raw.withColumn("value", F.make_valid_utf8("value"))
    lines = lines.withColumn("text", strip("value"))
    plain = F.when(F.col("text").rlike(_PLAIN), F.col("text"))
    lines = lines.withColumn("typed", F.from_json(plain, RECORD_SCHEMA))
    is_plain = F.col("typed").isNotNull()
    parsed = lines.withColumn("doc", _parse(F.when(~is_plain, F.col("text"))))
    # Two elements and no third: text of the line cannot pass for the end mark.
    whole = F.coalesce(F.try_variant_get("doc", "$[1]", "string") == _END, F.lit(False)) & F.try_variant_get(
        "doc", "$[2]", "variant"
    ).isNull()
    retried = _parse(F.regexp_replace("text", _NON_FINITE_TOKEN, "$1null"))
    return parsed.withColumn(
        "parse_reason",
        # A whole JSON value that starts with a brace is an object.
        F.when(is_plain, F.lit(None))
        .when(F.col("text") == "", F.lit(BLANK))
        .when(whole, F.when(~F.col("text").startswith("{"), F.lit(NOT_OBJECT)))
        .when(F.col("text").rlike(_NON_FINITE_TOKEN) & retried.isNotNull(), F.lit(NON_FINITE))
        .otherwise(F.lit(BAD_JSON)),
    ).drop("text")


def _text_rule(name: str) -> Column:
    kind, text = F.col(f"kind_{name}"), F.col(name)
    rule = (
        F.when(kind.isNull(), F.lit(f"{name}: missing"))
        .when(kind != "STRING", F.lit(f"{name}: not_a_string"))
        .when(text == "", F.lit(f"{name}: blank"))
    )
    if name == "router_id":
        rule = rule.when(F.length(text) > ROUTER_ID_MAX_LENGTH, F.lit(f"{name}: too_long"))
    return rule


def _number(name: str) -> Column:
    """The field as a double. Text must spell a number; text for NaN gives NaN."""
    v = F.col(f"m.{name}")
    text = F.try_variant_get(v, "$", "string")
    spelled = F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double")).when(
        text.rlike(_NON_FINITE_TEXT), F.lit(float("nan"))
    )
    return F.when(F.col(f"kind_{name}") == "STRING", spelled).otherwise(
        F.try_variant_get(v, "$", "double")
    )


def _number_rule(name: str) -> Column:
    x = F.col(name)
    percent = name in PERCENT_METRICS
    top = 100.0 if percent else sys.float_info.max
    broken = (
        F.when(F.col(f"kind_{name}").isNull(), F.lit(f"{name}: missing"))
        .when(x.isNull(), F.lit(f"{name}: not_a_number"))
        .when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(f"{name}: {NON_FINITE}"))
        .when(x < 0, F.lit(f"{name}: below_minimum"))
    )
    if percent:
        broken = broken.otherwise(F.lit(f"{name}: above_maximum"))
    # NaN is above every number, so the range test alone finds the good values.
    return F.when(~F.coalesce(x.between(0.0, top), F.lit(False)), broken)


def label(parsed: DataFrame) -> DataFrame:
    """Extract the record fields and give each line its first broken rule, if any.

    Adds `RECORD_FIELDS`, `event_time` and `reject_reason` (NULL for a valid record).
    Numbers may come as numeric text or booleans; text fields must be text.

    Each step builds on columns of the one before, so that every field is taken out
    of the document and inspected once. The last step hands the columns on through a
    one-row `inline`: a filter on the verdict then stays above it instead of being
    pushed below, where the whole evaluation would run a second time.
    """
    keep = [c for c in parsed.columns if c not in ("doc", "typed", "parse_reason")]
    plain = F.col("typed").isNotNull()
    shape = "struct<" + ",".join(f"{f}:variant" for f in RECORD_FIELDS) + ">"
    members = parsed.select(
        *keep, "typed", "parse_reason", F.try_variant_get("doc", "$[0]", shape).alias("m")
    )

    def kind(f: str) -> Column:
        own = F.lit("DOUBLE") if f in METRICS else F.when(F.col(f"typed.{f}").isNull(), F.lit("VOID")).otherwise(F.lit("STRING"))
        return F.when(plain, own).otherwise(F.schema_of_variant(F.col(f"m.{f}")))

    kinds = members.select("*", *[kind(f).alias(f"kind_{f}") for f in RECORD_FIELDS])

    def text(f: str) -> Column:
        return F.when(plain, F.col(f"typed.{f}")).otherwise(F.try_variant_get(F.col(f"m.{f}"), "$", "string"))

    values = kinds.select(
        *keep,
        "parse_reason",
        *[f"kind_{f}" for f in RECORD_FIELDS],
        strip(text("timestamp")).alias("timestamp"),
        strip(text("router_id")).alias("router_id"),
        *[F.when(plain, F.col(f"typed.{m}")).otherwise(_number(m)).alias(m) for m in METRICS],
        F.when(F.col("kind_status").isNull(), F.lit(DEFAULT_STATUS))
        .otherwise(text("status"))
        .alias("status"),
        text("active_fault").alias("active_fault"),
    )
    reason = F.coalesce(
        F.col("parse_reason"),
        _text_rule("timestamp"),
        _text_rule("router_id"),
        *[_number_rule(m) for m in METRICS],
        F.when(F.col("kind_status") != "STRING", F.lit("status: not_a_string")),
        F.when(
            ~F.col("kind_active_fault").isin("STRING", "VOID"),
            F.lit("active_fault: not_a_string"),
        ),
    )
    row = F.struct(
        *keep,
        *RECORD_FIELDS,
        parse_time("timestamp").alias("event_time"),
        reason.alias("reject_reason"),
    )
    return values.select(F.inline(F.array(row)))


def accepted(labelled: DataFrame) -> DataFrame:
    """The valid records of a labelled DataFrame."""
    return labelled.filter(F.col("reject_reason").isNull()).drop("reject_reason", "value")


def is_rejected() -> Column:
    """True for a line that counts as an error."""
    return F.col("reject_reason").isNotNull() & (F.col("reject_reason") != BLANK)


def rejected(labelled: DataFrame) -> DataFrame:
    """The rejected lines with their reason."""
    return labelled.filter(is_rejected()).select(
        "value", "src_file", "src_pos", "reject_reason"
    )


def validate(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed lines into `(valid, rejects)`. Persist the input to parse once."""
    labelled = label(parsed)
    return accepted(labelled), rejected(labelled)


def strict_times(labelled: DataFrame) -> DataFrame:
    """Also reject records whose time text cannot be read (accepted by default)."""
    return labelled.withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason",
            F.when(F.col("event_time").isNull(), F.lit("timestamp: not_a_time")),
        ),
    )


def reject_reason_counts(rejects: DataFrame) -> DataFrame:
    """Rejected lines per reason."""
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("lines"))


def canonicalize(df: DataFrame) -> DataFrame:
    """Records in their written form: fixed decimals, millisecond UTC time text."""
    changes = {m: round_dp(m, d) for m, d in CANONICAL_DIGITS.items()}
    changes["timestamp"] = iso_text("event_time")
    return df.withColumns(changes).select(*RECORD_FIELDS)


def first_arrival(
    df: DataFrame,
    key: Sequence[str] = ("router_id", "timestamp"),
    order: Sequence[str] = ("src_file", "src_pos"),
) -> DataFrame:
    """One row per key: the one that arrived first.

    The reduction starts on the map side, so many copies of one key cost no more
    than one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    )
    return picked.select(
        *[F.col(c) if c in key else F.col(f"first.{c}").alias(c) for c in df.columns]
    )


def latest_by_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One row per key: the last write, by `order`."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return picked.select(
        *[F.col(c) if c in key else F.col(f"last.{c}").alias(c) for c in df.columns]
    )


def insert_or_ignore(
    batch: DataFrame,
    table: DataFrame,
    key: Sequence[str] = ("router_id", "timestamp"),
    order: Sequence[str] = ("src_file", "src_pos"),
) -> DataFrame:
    """The rows of `batch` that are new to `table`, first arrival per key.

    The table is first cut down to the keys of the batch. With a batch under the
    broadcast threshold that needs no shuffle of the table; otherwise both sides
    meet in a sort-merge join, which adaptive execution splits where it is skewed.
    """
    fresh = first_arrival(batch, key, order)
    seen = table.select(*key).join(batch.select(*key), list(key), "left_semi")
    return fresh.join(seen, list(key), "left_anti")
