import datetime as dt

from paramo import fixed_values as fv
from paramo.session import shared_path
from paramo.sources import loading
from paramo.streaming import streams as st

SCHEMA = "k string, ts timestamp, value double, variable string"


def land(spark, path, *files):
    for rows in files:  # one file per arrival, in time order
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_insert_ignore_over_micro_batches(spark):
    src, table = shared_path(spark, "src"), shared_path(spark, "out")
    land(spark, src, [("a", at(1), 1.0, "x"), ("a", at(2), 2.0, "x")], [("a", at(3), 3.0, "x"), ("b", at(3), 4.0, "x"), (None, at(3), 5.0, "x")],
         [("b", at(1), 6.0, "x"), ("c", at(1), 7.0, "x")])
    schema = spark.createDataFrame([], SCHEMA).schema
    loading.create(spark, table, schema)
    offsets = shared_path(spark, "offsets")
    stream = st.file_stream(spark, src, schema, files_per_trigger=1)
    st.insert_ignore(stream, table, ["k"], ["ts"], offsets).awaitTermination()
    # late rows are kept whole: c arrives after later days and is still loaded
    assert sorted((r["k"] or "", r["value"]) for r in loading.loaded(spark, table).collect()) == [("", 5.0), ("a", 1.0), ("b", 4.0), ("c", 7.0)]
    st.insert_ignore(stream, table, ["k"], ["ts"], offsets).awaitTermination()
    assert loading.loaded(spark, table).count() == 4


def test_a_replayed_load_adds_nothing(spark):
    table = shared_path(spark, "out")
    batch = spark.createDataFrame([("a", at(1), 1.0, "x"), (None, at(1), 2.0, "x")], SCHEMA)
    loading.create(spark, table, batch.schema)
    for load in ("s-0", "s-0", "s-1", "s-1"):
        loading.insert_once(spark, table, batch, ["k"], ["ts"], load)
    # a null key never conflicts, so each of the two loads has its own; replays add none
    assert sorted(r["k"] or "" for r in loading.loaded(spark, table).collect()) == ["", "", "a"]


def test_climate_windows_are_current_before_they_close(spark):
    src, out = shared_path(spark, "src"), shared_path(spark, "out")
    land(spark, src, [("s", at(1), 1.0, fv.RAIN), ("s", at(2), 3.0, fv.RAIN)], [("s", at(20), 200.0, fv.RAIN)],
         [("s", at(21), 200.0, fv.RAIN)], [("s", at(2), 9.0, fv.RAIN), ("s", at(25), 1.0, fv.TEMP)])
    stream = st.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    st.upsert(st.climate_alerts(stream, delay="1 day"), out, shared_path(spark, "offsets")).awaitTermination()
    rows = st.latest(spark, out, ["window_start", "variable"]).collect()
    first = [r for r in rows if r["window_start"] == dt.datetime(2024, 1, 1)]
    assert first[0]["n"] == 2 and first[0]["mean"] == 2.0 and first[0]["alert"] == "sequia"
    # the newest window is still open and already there; every window is there once
    assert max(r["window_end"] for r in rows) == dt.datetime(2024, 2, 1)
    assert len({(r["window_start"], r["variable"]) for r in rows}) == len(rows)
    open_rain = [r for r in rows if r["window_start"] == dt.datetime(2024, 1, 20) and r["variable"] == fv.RAIN]
    assert open_rain[0]["n"] == 2 and open_rain[0]["mean"] == 200.0


def test_zscore_flags(spark):
    src, out = shared_path(spark, "src"), shared_path(spark, "out")
    land(spark, src, [("s", at(1), 10.0, fv.TEMP), ("s", at(1), 16.0, fv.TEMP), ("s", at(1), 1.0, "other")])
    stats = spark.createDataFrame([(fv.TEMP, 10.0, 2.0)], "feature string, mean double, std double")
    stream = st.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    st.to_files(st.zscore_flags(stream, stats), out, shared_path(spark, "offsets")).awaitTermination()
    found = {r["variable"] + str(r["value"]): (r["z"], r["severity"]) for r in spark.read.parquet(out).collect()}
    assert found == {fv.TEMP + "10.0": (0.0, "NORMAL"), fv.TEMP + "16.0": (3.0, "CRÍTICA"), "other1.0": (None, None)}


def test_versions_are_merged_and_nothing_is_lost(spark, tmp_path):
    path, want = str(tmp_path / "v"), {}
    for number in range(23):
        rows = [(k, number * 100 + k) for k in {number % 5, number % 7, 40 + number}]
        want.update(rows)
        batch = spark.createDataFrame(rows, "k int, v int")
        st.write_version(path, batch, number, ["k"], 5)
        if number in (10, 12):  # a batch that runs again
            st.write_version(path, batch, number, ["k"], 5)
        assert sum(p.name.startswith("version=") for p in (tmp_path / "v").iterdir()) <= 6
    assert {(r["k"], r["v"]) for r in st.latest(spark, path, ["k"]).collect()} == set(want.items())
    # after a crash between the merged version and the end of the clearing, the merged one is not made anew from what is left
    batch = spark.createDataFrame([(99, 1)], "k int, v int")
    st.write_version(path, batch, 25, ["k"], 5)
    spark.createDataFrame([(0, -1)], "k int, v int").write.parquet(f"{path}/version=23")
    st.write_version(path, batch, 25, ["k"], 5)
    assert {(r["k"], r["v"]) for r in st.latest(spark, path, ["k"]).collect()} == set(want.items()) | {(99, 1)}


def test_loads_leave_no_staged_tables(spark, tmp_path):
    from pathlib import Path

    from paramo.session import run_root
    from paramo.sources import loading
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2), (1, 3)], "k int, o int")
    loading.create(spark, path, rows.schema)
    before = set(Path(run_root(spark).removeprefix("file:")).glob("stage-*"))
    for n in range(3):
        loading.insert_once(spark, path, rows.withColumn("k", rows.k + n), ["k"], ["o"], f"l{n}")
    assert sorted(map(tuple, loading.loaded(spark, path).collect())) == [(1, 2), (2, 2), (3, 2)]
    assert set(Path(run_root(spark).removeprefix("file:")).glob("stage-*")) == before


def test_climate_windows_take_late_rows_without_a_delay(spark):
    src, out = shared_path(spark, "src"), shared_path(spark, "out")
    land(spark, src, [("s", at(1), 1.0, fv.RAIN), ("s", at(2), 3.0, fv.RAIN)], [("s", at(21), 200.0, fv.RAIN)], [("s", at(2), 9.0, fv.RAIN)])
    stream = st.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    st.upsert(st.climate_alerts(stream), out, shared_path(spark, "offsets"), keys=["window_start", "variable"], every=2).awaitTermination()
    first = [r for r in st.latest(spark, out, ["window_start", "variable"]).collect() if r["window_start"] == dt.datetime(2024, 1, 1)]
    assert [(r["n"], r["top"]) for r in first] == [(3, 9.0)]
