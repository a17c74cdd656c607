"""Expected rates by region for places without measurements (deterministic part only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramo import fixed_values as fv


def _rates(places: DataFrame, region: str, table: dict[str, tuple], names: list[str]) -> DataFrame:
    """Places with the rates of their region, or of the default row.  The table has 14 rows."""
    schema = ", ".join(["_region string", *[f"{n} double" for n in names]])
    dim = places.sparkSession.createDataFrame(
        [(k, *v) for k, v in table.items() if k != fv.DEFAULT_REGION], schema)
    out = places.join(F.broadcast(dim), F.col(region) == F.col("_region"), "left").drop("_region")
    return out.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, table[fv.DEFAULT_REGION])})


def _percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def connectivity(places: DataFrame, keys: tuple[str, ...] = ("place_id",), region: str = "region") -> DataFrame:
    """Urban and rural rates of every place."""
    def zone(name: str, fixed: float, mobile: float, kind: str) -> Column:
        return F.struct(F.lit(name).alias("zone"), F.lit(kind).alias("connection"),
                        _percent(F.col("internet") * fixed).alias("pct_internet"),
                        _percent(F.col("mobile") * mobile).alias("pct_mobile"),
                        _percent(F.col("computer") * fixed).alias("pct_computer"))
    zones = F.array(zone("urbana", 1.0, 1.0, "mixta"),
                    zone("rural", fv.RURAL_FIXED_FACTOR, fv.RURAL_MOBILE_FACTOR, "movil"))
    out = _rates(places, region, fv.CONNECTIVITY_RATES, ["internet", "mobile", "computer"])
    return out.select(*keys, F.inline(zones)).withColumn("fuente", F.lit(fv.SIMULATED_CONNECTIVITY))


def education(places: DataFrame, keys: tuple[str, ...] = ("place_id",), region: str = "region",
              enrolled: str | None = None) -> DataFrame:
    """Net coverage and enrolment share of the four levels of every place."""
    levels = F.array(*[F.struct(F.lit(lv).alias("level"), _percent(F.col(lv)).alias("net_rate"),
                                F.lit(fv.EDUCATION_SHARES[lv]).alias("share")) for lv in fv.EDUCATION_LEVELS])
    out = _rates(places, region, fv.EDUCATION_RATES, fv.EDUCATION_LEVELS)
    cols = [*keys, enrolled] if enrolled else list(keys)
    out = out.select(*cols, F.inline(levels)).withColumn("fuente", F.lit(fv.SIMULATED_EDUCATION))
    if enrolled:
        out = out.withColumn(enrolled, F.floor(F.col(enrolled) * F.col("share")))
    return out
