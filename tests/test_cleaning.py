import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from paramo.functions import parsing as p
from paramo.operators import normalise as n


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(expr.alias("x"), "i").orderBy("i").collect()]


def test_dates(spark):
    values = ["2024-01-15T00:00:00.000", "2024-01-15T00:00:00", "2024-01-15", "15/01/2024", "2024-1-5", "2024-02-30", "2024-01", "", None]
    day = dt.date(2024, 1, 15)
    assert column(spark, values, p.to_date("v")) == [day, day, day, None, dt.date(2024, 1, 5), None, None, None, None]


def test_numbers(spark):
    values = ["3.9", "-0", " 7 ", "1e3", "abc", "", None, "0", "5d", "1_000", "Infinity", "-inf"]
    assert column(spark, values, p.to_double("v")) == [3.9, 0.0, 7.0, 1000.0, None, None, None, 0.0, None, None, math.inf, -math.inf]
    assert math.isnan(column(spark, ["NaN"], p.to_double("v"))[0])
    assert column(spark, [*values, "NaN", "9999999999"], p.to_int("v")) == [3, 0, 7, 1000, None, None, None, 0, None, None, None, None, None, None]
    assert column(spark, ["0", "", "2.5", None], p.zero_to_null("v")) == [None, None, 2.5, None]


def test_text(spark):
    assert column(spark, [" ¿Cuánta  LLUVIA, mañana?\n", "Quindío_1 niño", "", None], p.clean_text("v")) == ["cuanta lluvia manana", "quindio_1 nino", "", None]
    grams = column(spark, ["uno dos tres", "uno", "a"], p.text_grams(p.words("v")))
    assert grams == [["uno", "dos", "tres", "uno dos", "dos tres"], ["uno"], []]


def test_lookup_keeps_unknown_places(spark):
    df = spark.createDataFrame([(" BOGOTÁ ",), ("Cali",), ("Nowhere",), (None,)], "m string")
    out = {r["m"]: r["code"] for r in n.lookup_code(df, "m").collect()}
    assert out == {" BOGOTÁ ": "11001", "Cali": "76001", "Nowhere": None, None: None}


def test_both_spellings_of_climate_fields(spark):
    rows = [({"municipio": "Cali", "valorobservado": "0"},), ({"Municipio": "Cali", "ValorObservado": "2.5", "FechaObservacion": "2024-01-02T10:00:00"},)]
    out = n.climate(spark.createDataFrame(rows, "record map<string,string>")).orderBy("valor_observado").collect()
    assert [r["valor_observado"] for r in out] == [0.0, 2.5]  # a numeric zero is a value, not a gap
    assert {r["codigo_dane"] for r in out} == {"76001"} and out[1]["fecha"] == dt.date(2024, 1, 2)


def test_reject_reasons(spark):
    df = spark.createDataFrame([("a", "5"), ("", "5"), ("b", "0"), ("c", "x"), (None, None)], "municipio string, indice_penetracion string")
    out = {r["reason"]: r["rows"] for r in n.reject_counts(df, n.connectivity_reason(df)).collect()}
    assert out == {"ok": 1, "no_name": 2, "zero_value": 1, "unparsable": 1}
    assert n.connectivity(df, 2023).count() == 1


@pytest.mark.parametrize("variable,value,kept", [("precipitacion_mm", 0.0, True), ("precipitacion_mm", 1000.0, False), ("temperatura_c", -5.0, False), ("temperatura_c", 44.9, True), ("otra", 1.0, False)])
def test_plausible_limits(spark, variable, value, kept):
    df = spark.createDataFrame([(variable, value, dt.datetime(2024, 1, 1))], "variable string, value double, ts timestamp")
    assert n.plausible(df).count() == int(kept)
