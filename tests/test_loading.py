from pyspark.sql import functions as F

from paramo import schemas
from paramo.session import shared_path
from paramo.sources import feeds, loading


def batch(spark):
    rows = [("a", 1, 10, "x"), ("a", 1, 5, "y"), ("b", 1, 7, "z"), (None, 1, 1, "n1"), (None, 1, 1, "n1"), ("c", None, 3, "n3")]
    return spark.createDataFrame(rows, "k1 string, k2 int, ord int, v string")


def test_first_per_key_and_null_keys(spark):
    out = sorted((r["k1"] or "", r["v"]) for r in loading.first_per_key(batch(spark), ["k1", "k2"], ["ord"]).collect())
    assert out == [("", "n1"), ("", "n1"), ("a", "y"), ("b", "z"), ("c", "n3")]


def test_insert_ignore_twice(spark):
    path = shared_path(spark, "t")
    batch(spark).where("k1 = 'b'").write.parquet(path)
    first = loading.insert_ignore(spark, path, batch(spark), ["k1", "k2"], ["ord"]).first()
    assert (first["batch"], first["inserted"], first["skipped"]) == (6, 4, 2)
    # only rows with a null in the key are added again: they never conflict
    again = loading.insert_ignore(spark, path, batch(spark).where("k1 IS NOT NULL AND k2 IS NOT NULL"), ["k1", "k2"], ["ord"]).first()
    assert again["inserted"] == 0
    assert spark.read.parquet(path).where("k1 = 'a'").first()["v"] == "y"


def test_hot_key_stays_one_row(spark):
    df = spark.range(60000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (-F.col("id")).alias("ord"), "id")
    out = loading.first_per_key(df, ["k"], ["ord"])
    assert out.count() == 20001 and out.where("k = 'hot'").first()["id"] == 59999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_quality_report(spark):
    table = schemas.TABLES["connectivity"]
    df = spark.createDataFrame([(None, 2023, "m", "z"), ("123456", 2023, "m", "z"), ("1", 2023, "m", "z"), ("1", 2023, "m", "z")],
                               "codigo_dane string, anio int, tipo_conexion string, zona string")
    out = {(r["check"], r["column"]): r["failures"] for r in loading.quality_report(df, table).collect()}
    assert out[("missing", "codigo_dane")] == 1 and out[("too_long", "codigo_dane")] == 1
    assert out[("duplicate_key", "codigo_dane,anio,tipo_conexion,zona")] == 1


def test_conflicting_codes(spark):
    df = spark.createDataFrame([("Tenjo", "1"), ("Tenjo", "2"), ("Cali", "3")], "name string, code string")
    assert [r["name"] for r in loading.conflicting_codes(df, "name", "code").collect()] == ["Tenjo"]


def test_landed_json_keeps_broken_lines(spark):
    path = shared_path(spark, "pages")
    spark.createDataFrame([('{"a":"1","b":2}',), ('{"a":"x"}',), ('[{"a":3},{"a":4}]',), ('{"a":',)], "value string").write.text(path)
    rows = feeds.landed_json(spark, path, ["a", "b"]).collect()
    good = sorted((r["a"], r["b"]) for r in rows if r["_corrupt"] is None)
    assert good == [("1", "2"), ("3", None), ("4", None), ("x", None)]
    assert [r["_corrupt"] for r in rows if r["_corrupt"]] == ['{"a":']


def test_scan_pushes_down(spark):
    path = shared_path(spark, "scan")
    spark.range(1000).selectExpr("id", "id * 2 AS x", "cast(id AS string) AS wide").write.parquet(path)
    out = feeds.scan(spark.read.parquet(path), F.col("x") > 100, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,100)" in plan and "wide" not in plan.split("ReadSchema")[1]


def test_pages_meet(spark):
    df = spark.range(100)
    first = [r["id"] for r in feeds.page(df, ["id"], 1, 10).collect()]
    deep = [r["id"] for r in feeds.page(df.repartition(7), [F.col("id").desc()], 3, 20).collect()]
    assert deep == list(range(39, 19, -1))
    assert first == [r["id"] for r in feeds.page_after(df, "id", 9, 10).collect()] == list(range(10, 20))


def test_fallback_fills_only_missing_keys(spark):
    real = spark.createDataFrame([(1, "real")], "k int, fuente string")
    spare = spark.createDataFrame([(1, "sim"), (2, "sim")], "k int, fuente string")
    assert sorted((r["k"], r["fuente"]) for r in feeds.fill_from(real, spare, ["k"]).collect()) == [(1, "real"), (2, "sim")]
