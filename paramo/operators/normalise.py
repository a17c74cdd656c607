"""Conforming raw feed records to the shared schema (all expressions, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import parsing as p


def municipality_codes(spark: SparkSession) -> DataFrame:
    """(place_key, code): the built-in code table, under 100 rows."""
    return spark.createDataFrame(list(fv.MUNICIPALITY_CODES.items()), "place_key string, code string")


def toll_sites(spark: SparkSession) -> DataFrame:
    """(site_key, code, region, municipality, lat, lon): the built-in site table, 30 rows."""
    rows = [(k, *v) for k, v in fv.TOLL_SITES.items()]
    return spark.createDataFrame(
        rows, "site_key string, code string, region string, municipality string, lat double, lon double")


def lookup_code(df: DataFrame, name: str, codes: DataFrame | None = None, code: str = "code") -> DataFrame:
    """Add the code of a municipality name (blank- and case-insensitive); null when unknown.

    The built-in table is of fixed size and is broadcast; a caller's own table is left to
    Spark's size-checked choice.
    """
    dim = F.broadcast(municipality_codes(df.sparkSession)) if codes is None else codes
    dim = dim.select(F.col("place_key").alias("_key"), F.col("code").alias(code))
    return df.withColumn("_key", p.place_key(name)).join(dim, "_key", "left").drop("_key")


def count_unmatched(df: DataFrame, code: str = "code") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(code).isNull()).alias("unmatched"))


def enrich_sites(df: DataFrame, site: str = "peaje", sites: DataFrame | None = None) -> DataFrame:
    """Add place columns from the site name; nulls for a site that is not listed."""
    dim = F.broadcast(toll_sites(df.sparkSession)) if sites is None else sites
    dim = dim.select(F.col("site_key").alias("_key"), F.col("code").alias("codigo_dane"),
                     F.col("region").alias("departamento"), F.col("municipality").alias("municipio"),
                     F.col("lat").alias("latitud"), F.col("lon").alias("longitud"))
    return df.withColumn("_key", p.place_key(site)).join(dim, "_key", "left").drop("_key")


def tag(**values) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def tolls(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Toll records (already enriched with the site's place) -> shared schema."""
    return df.select(
        "codigo_dane", "departamento", "municipio",
        F.col("latitud").cast("double").alias("latitud"), F.col("longitud").cast("double").alias("longitud"),
        p.to_date("desde").alias("fecha"), *tag(sector=fv.SECTOR_TOLLS, fuente=fv.SOURCE_TOLLS),
        "idpeaje", "peaje", F.col("categoriatarifa").alias("categoria_tarifa"),
        p.to_date("desde").alias("fecha_inicio"), p.to_date("hasta").alias("fecha_fin"),
        p.to_double("valortarifa").alias("valor_tarifa"),
        p.to_int("cantidadtrafico").alias("cantidad_trafico"),
        p.to_int("cantidadevasores").alias("cantidad_evasores"),
        p.to_int("cantidadexentos787").alias("cantidad_exentos"), *keep,
    )


def price_index(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Price index records -> shared schema; the index is nationwide."""
    return df.select(
        *tag(**fv.NATIONAL), p.to_date("fecha").alias("fecha"),
        *tag(sector=fv.SECTOR_INDEX, fuente=fv.SOURCE_INDEX),
        *[p.to_double(c).alias(c) for c in
          ("indice_total", "total_fertilizantes", "total_plaguicidas", "total_otros")], *keep,
    )


# --- Fixed values: lower-case and CamelCase spelling of the climate feed's fields ---------
CLIMATE_FIELDS = {
    "municipio": "Municipio", "departamento": "Departamento", "latitud": "Latitud", "longitud": "Longitud",
    "fechaobservacion": "FechaObservacion", "codigoestacion": "CodigoEstacion",
    "nombreestacion": "NombreEstacion", "codigosensor": "CodigoSensor", "valorobservado": "ValorObservado",
    "unidadmedida": "UnidadMedida", "zonahidrografica": "ZonaHidrografica",
}


def climate(df: DataFrame, record: str = "record", codes: DataFrame | None = None,
            keep: Sequence[str] = ()) -> DataFrame:
    """Climate records -> shared schema.

    ``record`` is a MAP<STRING,STRING> (one landed JSON object): its keys are case-sensitive, so
    both spellings of a field can be told apart.
    """
    def get(name: str) -> Column:
        return F.coalesce(p.blank_to_null(F.col(record)[name]),
                          p.blank_to_null(F.col(record)[CLIMATE_FIELDS[name]]))

    flat = df.select(*[get(f).alias(f) for f in CLIMATE_FIELDS],
                     F.col(record)["tipo_variable"].alias("tipo_variable"), *keep)
    return lookup_code(flat, "municipio", codes, "codigo_dane").select(
        "codigo_dane", "departamento", "municipio",
        p.to_double("latitud").alias("latitud"), p.to_double("longitud").alias("longitud"),
        p.to_date("fechaobservacion").alias("fecha"), *tag(sector=fv.SECTOR_CLIMATE, fuente=fv.SOURCE_CLIMATE),
        F.col("codigoestacion").alias("codigo_estacion"), F.col("nombreestacion").alias("nombre_estacion"),
        F.col("codigosensor").alias("codigo_sensor"), "tipo_variable",
        p.to_double("valorobservado").alias("valor_observado"),
        F.col("unidadmedida").alias("unidad_medida"), F.col("zonahidrografica").alias("zona_hidrografica"), *keep,
    )


def _field(df: DataFrame, *names: str) -> Column:
    """First filled alternative among the columns the feed actually has."""
    present = [n for n in names if n in df.columns]
    return p.first_filled(*present) if present else F.lit(None).cast("string")


def _optional(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def bad_number(df: DataFrame, *names: str) -> Column:
    """True when any listed field is filled with something that is not a number."""
    checks = [F.col(n).isNotNull() & (F.col(n) != "") & p.to_double(n).isNull()
              for n in names if n in df.columns]
    out = F.lit(False)
    for check in checks:
        out = out | check
    return out


CONNECTIVITY_NUMBERS = ("indice_penetracion", "pct_hogares_internet", "latitud", "longitud", "pct_celular",
                        "pct_pc", "velocidad_promedio", "poblacion")
EDUCATION_NUMBERS = ("total_matriculados", "matriculados", "matriculados_oficial", "matriculados_no_oficial",
                     "tasa_cobertura_neta", "tasa_cobertura_bruta", "tasa_aprobacion", "tasa_desercion")


def connectivity_reason(df: DataFrame) -> Column:
    """Why a connectivity record is rejected; null when it is kept."""
    name = F.trim(F.coalesce(_field(df, "municipio", "nombre_municipio"), F.lit("")))
    pct = F.coalesce(p.to_double(_field(df, "indice_penetracion", "pct_hogares_internet")), F.lit(0.0))
    return (F.when(bad_number(df, *CONNECTIVITY_NUMBERS), "unparsable")
            .when(name == "", "no_name").when(pct == 0, "zero_value"))


def education_reason(df: DataFrame) -> Column:
    code = F.trim(F.coalesce(_field(df, "codigo_dane_municipio", "cod_mpio"), F.lit("")))
    name = F.trim(F.coalesce(_field(df, "municipio"), F.lit("")))
    return (F.when(bad_number(df, *EDUCATION_NUMBERS), "unparsable")
            .when(code == "", "no_code").when(name == "", "no_name"))


def connectivity(df: DataFrame, year: int, keep: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Connectivity records -> shared schema; rejected records are left out."""
    numbers = {n: p.zero_to_null(_field(df, n)) for n in CONNECTIVITY_NUMBERS}
    pct = F.coalesce(p.to_double(_field(df, "indice_penetracion", "pct_hogares_internet")), F.lit(0.0))
    return df.where(connectivity_reason(df).isNull()).select(
        F.trim(F.coalesce(_field(df, "codigo_dane", "cod_dane"), F.lit("00000"))).alias("codigo_dane"),
        F.trim(F.coalesce(_field(df, "departamento", "nombre_departamento"), F.lit(""))).alias("departamento"),
        F.trim(F.coalesce(_field(df, "municipio", "nombre_municipio"), F.lit(""))).alias("municipio"),
        numbers["latitud"].alias("latitud"), numbers["longitud"].alias("longitud"),
        F.lit(year).alias("anio"), F.make_date(F.lit(year), F.lit(12), F.lit(31)).alias("fecha"),
        p.rounded(pct, digits).alias("pct_hogares_internet"),
        numbers["pct_celular"].alias("pct_hogares_celular"), numbers["pct_pc"].alias("pct_hogares_pc"),
        _optional(df, "tipo_conexion", "mixta").alias("tipo_conexion"),
        numbers["velocidad_promedio"].alias("velocidad_mbps"),
        F.nullif(p.to_int(_field(df, "poblacion")), F.lit(0)).alias("poblacion"),
        _optional(df, "zona", "total").alias("zona"),
        *tag(sector=fv.SECTOR_CONNECTIVITY, fuente=fv.SOURCE_CONNECTIVITY), *keep,
    )


def education(df: DataFrame, year: int, keep: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Education records -> shared schema; rejected records are left out."""
    numbers = {n: p.zero_to_null(_field(df, n)) for n in EDUCATION_NUMBERS}
    enrolled = p.to_int(_field(df, "total_matriculados", "matriculados"))
    return df.where(education_reason(df).isNull()).select(
        F.trim(_field(df, "codigo_dane_municipio", "cod_mpio")).alias("codigo_dane"),
        F.trim(F.coalesce(_field(df, "departamento"), F.lit(""))).alias("departamento"),
        F.trim(_field(df, "municipio")).alias("municipio"),
        F.lit(None).cast("double").alias("latitud"), F.lit(None).cast("double").alias("longitud"),
        F.lit(year).alias("anio"), F.make_date(F.lit(year), F.lit(12), F.lit(31)).alias("fecha"),
        p.place_key(F.coalesce(_field(df, "nivel", "nivel_educativo"), F.lit("total"))).alias("nivel_educativo"),
        F.coalesce(enrolled, F.lit(0)).alias("matriculados"),
        F.nullif(p.to_int(_field(df, "matriculados_oficial")), F.lit(0)).alias("matriculados_oficial"),
        F.nullif(p.to_int(_field(df, "matriculados_no_oficial")), F.lit(0)).alias("matriculados_privado"),
        p.rounded(F.coalesce(p.to_double(_field(df, "tasa_cobertura_neta")), F.lit(0.0)), digits)
        .alias("tasa_cobertura_neta"),
        *[numbers[c].alias(c) for c in ("tasa_cobertura_bruta", "tasa_aprobacion", "tasa_desercion")],
        _optional(df, "zona", "total").alias("zona"),
        *tag(sector=fv.SECTOR_EDUCATION, fuente=fv.SOURCE_EDUCATION), *keep,
    )


def reject_counts(df: DataFrame, reason: Column) -> DataFrame:
    """Rows per reject reason; kept rows count under 'ok'."""
    return df.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("rows"))


def plausible(df: DataFrame, variable: str = "variable", value: str = "value", ts: str = "ts",
              limits: dict | None = None) -> DataFrame:
    """Physically possible values of the known variables, with a time and a value."""
    rule = F.lit(False)
    for name, (low, closed, high) in (limits or fv.PLAUSIBLE).items():
        above = F.col(value) >= low if closed else F.col(value) > low
        rule = rule | ((F.col(variable) == name) & above & (F.col(value) < high))
    return df.where(F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value)) & rule)


def fill_default(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Null or zero aggregates replaced by a default."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(v)) for c, v in defaults.items()})
