"""Display formats, labels, event classes and chart blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CHART_BLOCK = r"(?is)```chart\s*\n(.*?)```"
CHART_SCHEMA = (
    "type STRING, title STRING, data STRUCT<labels: ARRAY<STRING>, "
    "datasets: ARRAY<STRUCT<label: STRING, data: ARRAY<DOUBLE>>>>"
)
MISSING = "—"


def byte_size(n: Column) -> Column:
    """Bytes as ``12.3 KB``."""
    def shown(power: int, unit: str) -> Column:
        return F.format_string("%.1f " + unit, F.bround(n / F.lit(float(1024**power)), 1))

    out = shown(4, "TB")
    for power, unit in [(3, "GB"), (2, "MB"), (1, "KB"), (0, "B")]:
        out = F.when(n < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def label(key: Column) -> Column:
    """``unit_price`` to ``Unit Price``; inner capitals stay."""
    words = F.transform(F.split(key, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, " ")


def _or_missing(value: Column, shown: Column) -> Column:
    return F.when(value.isNull(), F.lit(MISSING)).otherwise(shown)


def currency(v: Column) -> Column:
    amount = F.format_number(F.abs(v), 2)
    return _or_missing(v, F.concat(F.when(v < 0, "-$").otherwise("$"), amount))


def percentage(v: Column, digits: int = 2) -> Column:
    return _or_missing(v, F.concat(F.format_string(f"%.{digits}f", F.round(v * 100, digits)), F.lit("%")))


def fixed(v: Column, digits: int = 2) -> Column:
    return _or_missing(v, F.format_string(f"%.{digits}f", F.round(v.cast("double"), digits)))


def grouped_number(v: Column) -> Column:
    """Thousands separators and up to three decimals."""
    return _or_missing(v, F.call_function("format_number", v, F.lit("#,##0.###")))


def event_class(action: Column) -> Column:
    a = F.lower(F.coalesce(action, F.lit("")))
    has = lambda word: F.contains(a, F.lit(word))
    return (
        F.when(has("login") & has("success"), "badge-success")
        .when(has("login") & has("fail"), "badge-error")
        .when(has("logout"), "badge-info")
        .when(has("delete") | has("lock") | has("error"), "badge-error")
        .otherwise("badge-warning")
    )


def chart_points(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Points of the fenced chart blocks of a text column; blocks that are no JSON are skipped."""
    blocks = df.select(
        *keys,
        F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CHART_BLOCK), F.lit(1))).alias(
            "block", "raw"
        ),
    ).filter(F.get_json_object(F.trim("raw"), "$").isNotNull())
    charts = blocks.select(*keys, "block", F.from_json("raw", CHART_SCHEMA).alias("c"))
    series = charts.select(
        *keys,
        "block",
        F.lower(F.trim("c.type")).alias("chart_type"),
        F.col("c.data.labels").alias("labels"),
        F.posexplode("c.data.datasets").alias("series", "ds"),
    )
    return series.select(
        *keys,
        "block",
        "chart_type",
        F.coalesce(F.nullif(F.col("ds.label"), F.lit("")), F.concat(F.lit("Series "), F.col("series") + 1)).alias("series_label"),
        "labels",
        F.posexplode("ds.data").alias("point", "value"),
    ).select(
        *keys, "block", "chart_type", "series_label", "point", F.get("labels", F.col("point")).alias("label"), "value"
    )
