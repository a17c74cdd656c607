"""Filter, top-k and projection reads over the conformed tables.

Every filter is a plain predicate on a stored column, so it reaches the Parquet scan;
``orderBy().limit()`` plans as a distributed top-k, never a full sort.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo.functions.parsing import contains_ci, rounded


def check_limit(limit: int, high: int) -> int:
    if not 1 <= limit <= high:
        raise ValueError(f"limit must be between 1 and {high}")
    return limit


def latest(df: DataFrame, date: str) -> Column:
    """Newest date of the table, as a scalar subquery: the default 'today'."""
    return df.agg(F.max(date)).scalar()


def newest(df: DataFrame, date: str, limit: int, tiebreak: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(date).desc_nulls_first(), *tiebreak).limit(limit)


def filter_range(df: DataFrame, start=None, end=None, start_col: str = "month", end_col: str | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(start_col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(end_col or start_col) <= F.lit(end).cast("date"))
    return df


def tolls(df: DataFrame, start=None, end=None, region: str | None = None, limit: int = 100,
          date: str = "month", end_col: str | None = None, region_col: str = "region",
          tiebreak: Sequence[str] = ("site_id", "category")) -> DataFrame:
    """Newest toll rows under optional period and region filters."""
    check_limit(limit, 1000)
    df = filter_range(df, start, end, date, end_col)
    if region:
        df = df.where(contains_ci(region_col, region))
    return newest(df, date, limit, tiebreak)


def by_code(df: DataFrame, code, code_col: str, date: str, limit: int = 50,
            tiebreak: Sequence[str] = (), high: int = 500) -> DataFrame:
    """Newest rows of one code; an empty result is the 'not found' answer."""
    return newest(df.where(F.col(code_col) == F.lit(code)), date, check_limit(limit, high), tiebreak)


def index_range(df: DataFrame, start=None, end=None, date: str = "month") -> DataFrame:
    return filter_range(df, start, end, date).orderBy(date)


def index_trend(df: DataFrame, value: str = "idx_total", date: str = "month", by: Sequence[str] = (),
                digits: int | None = 2, out: str = "change_pct") -> DataFrame:
    """Change against the previous period in percent; null when either side is null or zero.

    The table holds one row per period and series, so a window holds at most one calendar.
    """
    before = F.lag(value).over(W.partitionBy(*by).orderBy(date))
    usable = (F.nullif(before, F.lit(0)).isNotNull()) & (F.nullif(F.col(value), F.lit(0)).isNotNull())
    change = (F.col(value) - before) / before * 100
    return df.withColumn(out, rounded(F.when(usable, change), digits))


def climate_recent(df: DataFrame, days: int = 7, kind: str | None = None, region: str | None = None,
                   limit: int = 200, as_of: dt.date | None = None, date: str = "obs_date",
                   kind_col: str = "variable", region_col: str = "region", code=None,
                   code_col: str = "station", tiebreak: Sequence[str] = ("obs_id",), high: int = 2000) -> DataFrame:
    """Newest observations of the last ``days`` days, optionally by kind, region or code."""
    today = F.lit(as_of) if as_of else latest(df, date)
    out = df.where(F.col(date) >= F.date_sub(today, days))
    if code is not None:
        out = out.where(F.col(code_col) == F.lit(code))
    if kind:
        out = out.where(F.col(kind_col) == kind)
    if region:
        out = out.where(contains_ci(region_col, region))
    return newest(out, date, check_limit(limit, high), tiebreak)


def table_summary(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows, oldest and newest date per table, and the grand total under 'total'."""
    parts = None
    for name, (df, date) in tables.items():
        day = F.col(date).cast("date") if date else F.lit(None).cast("date")
        part = df.agg(F.count("*").alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi")).select(
            F.lit(name).alias("table_name"), "n", "lo", "hi")
        parts = part if parts is None else parts.unionByName(part)
    return parts.rollup("table_name").agg(
        F.sum("n").alias("rows"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"),
    ).withColumn("table_name", F.coalesce("table_name", F.lit("total")))


def health(summary: DataFrame) -> DataFrame:
    """One row: overall status, rows, empty tables and newest date."""
    parts = summary.where(F.col("table_name") != "total")
    return parts.agg(
        F.when(F.count_if(F.col("rows") == 0) > 0, "warning").otherwise("ok").alias("status"),
        F.sum("rows").alias("rows"),
        F.concat_ws("; ", F.sort_array(F.collect_list(
            F.when(F.col("rows") == 0, F.concat(F.col("table_name"), F.lit(" is empty")))))).alias("warnings"),
        F.max("last_date").alias("last_date"),
    )


def active_sources(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("table_name") != "total").select(
        "table_name", "rows", (F.col("rows") > 0).alias("ok"))


def connectivity(df: DataFrame, region: str | None = None, year: int | None = None, zone: str | None = None,
                 limit: int = 100, tiebreak: Sequence[str] = ("row_id",)) -> DataFrame:
    if region:
        df = df.where(contains_ci("region", region))
    if year is not None:
        df = df.where(F.col("year") == year)
    if zone:
        df = df.where(F.col("zone") == zone)
    return df.orderBy(F.col("pct_internet").desc_nulls_first(), *tiebreak).limit(limit)


def education(df: DataFrame, region: str | None = None, level: str | None = None, year: int | None = None,
              limit: int = 100, tiebreak: Sequence[str] = ("row_id",)) -> DataFrame:
    if region:
        df = df.where(contains_ci("region", region))
    if level:
        df = df.where(F.col("level") == level)
    if year is not None:
        df = df.where(F.col("year") == year)
    return df.orderBy(F.col("region").asc_nulls_last(), F.col("place").asc_nulls_last(), *tiebreak).limit(limit)


def projection(df: DataFrame, columns: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """Output shape of a table: a column subset with dates as ISO text."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in dates else F.col(c) for c in columns])


def distinct_values(df: DataFrame, column: str, null_label: str = "Sin dato") -> DataFrame:
    return df.select(F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias(column)).distinct().orderBy(column)


def text_search(df: DataFrame, text: str, columns: Sequence[str], **equals) -> DataFrame:
    """Rows where any column contains the text, with optional equality filters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_ci(c, text)
    for c, v in equals.items():
        df = df.where(F.col(c) == v)
    return df.where(hit)


def geo_points(df: DataFrame, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
