"""Reading landed feed pages and scanning sources with pushed-down filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramo.operators.query import latest
from paramo.session import materialise

CORRUPT = "_corrupt"


def landed_json(spark: SparkSession, path: str, fields: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Landed JSON pages as one dataset of strings.

    A line may be one object or one array of objects; ``multi_line`` reads pages whose array spans lines
    (such a file is not split).  There is no inference pass, and text that is not JSON stays in ``_corrupt``.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, CORRUPT]])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", CORRUPT).option("primitivesAsString", "true").json(path))


def landed_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines as MAP<STRING,STRING> records with case-sensitive keys."""
    return spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("record"))


def scan(df: DataFrame, where: Column | str | None = None, select: Sequence[str] | None = None,
         order: Sequence[Column | str] = (), limit: int | None = None) -> DataFrame:
    """Filter, projection, order and cap, all left to the source and the optimizer."""
    if where is not None:
        df = df.where(where)
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*select) if select else df


def since(df: DataFrame, date: str, start) -> DataFrame:
    return df.where(F.col(date) >= F.lit(start).cast(df.schema[date].dataType))


def last_days(df: DataFrame, ts: str, days: int = 30, as_of: dt.date | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (the newest day when not given)."""
    today = F.lit(as_of) if as_of else latest(df, ts).cast("date")
    return df.where(F.col(ts) >= F.date_sub(today, days).cast(df.schema[ts].dataType))


def stacked(feeds: Mapping[str, DataFrame], tag: str = "variable") -> DataFrame:
    """Same-schema feeds under a literal tag column."""
    out = None
    for name, df in feeds.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def count(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    return scan(df, where).agg(F.count("*").alias("rows"))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)


def catalog(df: DataFrame, columns: Sequence[str], code: str) -> DataFrame:
    """A dimension feed: the named columns, ordered by code."""
    return df.select(*columns).orderBy(code)


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) over a total order.

    The first page is a distributed top-k.  For any other that would move everything before it through one
    task, so the rows are sorted into a written table and found by their exact rank: row ids grow with the
    sort order, and the rows of earlier partitions are added up (one row per partition).
    """
    first = number * size
    if not number:
        return df.orderBy(*order).limit(size)
    ranked = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranked = ranked.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranked.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_row")
    return ranked.join(starts, "_part").where((rank >= first) & (rank < first + size)).drop("_id", "_part", "_row", "_start").orderBy(*order)


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page after the last key seen: a filter and a small top-k however deep it is."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def fill_from(real: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Real rows, plus the fallback rows of keys that have none."""
    return real.unionByName(fallback.join(real.select(*keys), list(keys), "left_anti"))
