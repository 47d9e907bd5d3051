"""S, W: sources and store (invariant 1)."""

from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from weekcell.functions import calendar as cal
from weekcell.sources import readers, store, versions
from weekcell.sources.schemas import GRID_SCHEMA, conform

T = datetime.fromisoformat
NOW = T("2023-04-15 12:00:00")
COLS = "unique_key string, created_date timestamp_ntz, complaint_type string, descriptor string, status string, latitude double"


def req(spark, data):
    return spark.createDataFrame([(k, T(t), "Parking", "Lane", s, lat) for k, t, s, lat in data], COLS)


FIRST = [("1", "2023-01-31 23:59:59", "Open", 40.75), ("2", "2023-02-01 00:00:00", "Open", 40.75), ("3", "2023-03-12 02:30:00", "Open", 40.75)]


def test_W1_W5_invariant1_overlapping_pull_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    months = ["2023-01", "2023-02", "2023-03"]
    store.ingest_rows(spark, path, req(spark, FIRST), months, NOW)
    before = rows(readers.read_store(spark, path))
    again = store.ingest_rows(spark, path, req(spark, FIRST[1:]), months[1:], NOW)
    assert rows(readers.read_store(spark, path)) == before
    assert rows(again, "month", "fetched", "new", "updated", "rows") == [("2023-02", 1, 0, 0, 1), ("2023-03", 1, 0, 0, 1)]


def test_W2_updates_null_changes_and_vanished_rows(spark):
    new = req(spark, [("1", "2023-01-31 23:59:59", "Closed", 40.75), ("2", "2023-02-01 00:00:00", "Open", None), ("9", "2023-02-02 00:00:00", "Open", 1.0)])
    st = store.change_counts(req(spark, FIRST), new, ["created_date", "status", "latitude"]).first().asDict()
    assert st == {"fetched": 3, "new": 1, "updated": 2, "missing_from_source": 1, "rows": 4}
    merged = {r["unique_key"]: r for r in store.merge_newest(req(spark, FIRST), new).collect()}
    assert merged["1"]["status"] == "Closed" and merged["2"]["latitude"] is None and "3" in merged


def test_W3_W4_guards_stop_the_write(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="more than once"):
        store.ingest_rows(spark, path, req(spark, [FIRST[0], FIRST[0]]), ["2023-01"], NOW)
    with pytest.raises(ValueError, match="outside"):
        store.ingest_rows(spark, path, req(spark, FIRST), ["2023-01"], NOW)
    assert not (tmp_path / "s").exists()


def test_W7_W8_empty_month_and_control(spark, tmp_path):
    path = str(tmp_path / "store")
    done = store.ingest_rows(spark, path, req(spark, FIRST[:1]), ["2022-12", "2023-01"], NOW)
    assert rows(done, "month", "rows") == [("2022-12", 0), ("2023-01", 1)]
    ctl = store.read_control(spark, path + "_control")
    assert rows(ctl, "month", "complete", "rows") == [("2022-12", True, 0), ("2023-01", True, 1)]


def test_W6_whole_month_replace(spark, tmp_path):
    path = str(tmp_path / "grid")
    g = lambda n, m: conform(spark.createDataFrame([(m, 40.8, -73.9, n), (m, None, None, 2)], "month string, grid_lat double, grid_lon double, n bigint"), GRID_SCHEMA)
    store.ingest_grid(spark, path, g(7, "2023-03").unionByName(g(5, "2023-04")), ["2023-03", "2023-04"], NOW)
    done = store.ingest_grid(spark, path, g(9, "2023-04"), ["2023-04"], NOW)
    assert rows(done, "month", "cells", "rows", "no_location") == [("2023-04", 1, 11, 2)]
    assert rows(readers.read_store(spark, path, ["month", "n"])) == [("2023-03", 2), ("2023-03", 7), ("2023-04", 2), ("2023-04", 9)]
    # a month that comes back empty is emptied; rows of other months are refused
    done = store.ingest_grid(spark, path, g(4, "2023-04"), ["2023-03", "2023-04"], NOW)
    assert rows(done, "month", "rows") == [("2023-03", 0), ("2023-04", 6)]
    assert rows(readers.read_store(spark, path, ["month", "n"])) == [("2023-04", 2), ("2023-04", 4)]
    with pytest.raises(Exception, match="outside"):
        store.ingest_grid(spark, path, g(4, "2023-05"), ["2023-04"], NOW)


@pytest.mark.parametrize("month, now, done", [("2023-04", "2023-05-04 02:00:00", False), ("2023-04", "2023-05-04 05:00:00", True),
                                              ("2026-09", "2026-10-03 12:00:00", False), ("2026-09", "2026-10-04 12:00:00", True)])
def test_W9_completeness_waits_three_local_days(spark, month, now, done):
    r = spark.range(1).select(cal.is_complete(cal.label_index(F.lit(month)), F.lit(now).cast("timestamp_ntz")).alias("c")).first()
    assert r["c"] is done


def test_W10_build_range(spark):
    def ctl(gaps=()):
        return spark.createDataFrame([(s, f"2021-{m:02d}", (s, m) not in gaps) for s in "ab" for m in range(1, 7 if s == "a" else 6)],
                                     "store string, month string, complete boolean")
    assert store.check_build_range(ctl(), "2021-01") == ("2021-01", "2021-05")
    with pytest.raises(ValueError, match="2021-03"):
        store.check_build_range(ctl({("b", 3)}), "2021-01")
    with pytest.raises(ValueError):
        store.check_build_range(ctl(), "2021-01", at_least="2021-06")


def test_W11_overlap_start_crosses_the_year(spark):
    r = spark.range(1).select(cal.overlap_start(F.lit("2023-01")).alias("a"), cal.overlap_start(F.lit("2023-05"), 3).alias("b")).first()
    assert (r["a"], r["b"]) == ("2022-12", "2023-03")


def test_W12_run_log_appends(spark, tmp_path):
    for n in (1, 2):
        store.append_run_log(str(tmp_path / "log"), spark.createDataFrame([(n,)], "kept bigint"))
    assert rows(spark.read.schema("kept bigint").json(str(tmp_path / "log"))) == [(1,), (2,)]


def test_S1_routing_splits_at_the_border(spark):
    src = lambda s: req(s, [("a", "2019-12-31 23:59:59", "x", 1.0), ("b", "2020-01-01 00:00:00", "x", 1.0)])
    cov = [readers.Coverage("old", src, "2010-01-01", "2020-01-01"), readers.Coverage("new", src, "2020-01-01", None)]
    assert rows(readers.routed_scan(spark, cov, "2019-01-01", "2021-01-01"), "unique_key", "source_dataset") == [("a", "old"), ("b", "new")]
    assert readers.clip(cov[0], "2020-01-01", None) is None
    assert readers.clip(cov[1], "2019-06-01", "2020-06-01") == ("2020-01-01", "2020-06-01")


def test_S2_month_chunks(spark):
    r = spark.createDataFrame([(date(2023, 11, 20), date(2024, 1, 5))], "start date, end date")
    assert rows(cal.month_chunks(r), "lo", "hi") == [(date(2023, 11, 20), date(2023, 12, 1)), (date(2023, 12, 1), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 1, 5))]


def test_S6_malformed_values_fail_and_missing_columns_are_null(spark):
    raw = spark.createDataFrame([("1", "2023-01-01T05:00:00.000", "40.5")], "unique_key string, created_date string, latitude string")
    r = readers.normalize_events(raw, "feed").first()
    assert (r["created_date"], r["latitude"], r["borough"], r["source_dataset"]) == (T("2023-01-01 05:00:00"), 40.5, None, "feed")
    with pytest.raises(Exception):
        readers.normalize_events(raw.withColumn("latitude", F.lit("x")), "feed").collect()


def test_S9_S17_trip_files_of_both_layouts(spark, tmp_path):
    (tmp_path / "new.csv").write_text("ride,started_at,ended_at, Start_Lat,start_lng,end_lat,end_lng\n1,2024-01-31 23:00:00,2024-02-01 00:10:00,40.7,-74.0,,\n")
    (tmp_path / "old.csv").write_text('starttime,stoptime,start station latitude,start station longitude,end station latitude,end station longitude\n2019-05-01 01:00:00,2019-05-01 01:10:00,40.71,-73.9,40.71,-73.9\n')
    ends = readers.trip_ends(readers.read_trips(spark, [str(tmp_path / "new.csv"), str(tmp_path / "old.csv")]))
    assert rows(ends, "kind", "month", "lat", "n") == [("end", "2019-05", 40.71, 1), ("end", "2024-02", None, 1), ("start", "2019-05", 40.71, 1), ("start", "2024-01", 40.7, 1)]
    wide = readers.trip_cell_months(readers.trip_cells(ends))
    assert wide.agg(F.sum("starts"), F.sum("ends")).first()[:] == (2, 1)
    with pytest.raises(ValueError, match="layout"):
        readers.trip_layout(["a", "b"])


def test_S10_S11_archives(spark, tmp_path):
    names = ["2024-citibike-tripdata.zip", "202607-citibike-tripdata.csv.zip", "202608-citibike-tripdata.csv.zip", "JC-202609-citibike-tripdata.csv.zip", "index.html"]
    for n in names:
        (tmp_path / n).write_text("x")
    files = readers.list_archives(readers.list_files(spark, str(tmp_path)), 2025)
    assert [r["name"] for r in files.collect()] == names[1:3]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert readers.covered_through(df).first()[0] == "2026-08"
    assert readers.covered_through(df.where("name LIKE '2024-%'")).first()[0] is None


def test_S12_S13_lots(spark):
    lots = readers.normalize_lots(spark.createDataFrame([("1", "24v1", "n/a"), ("2", "24v1", "30.5")], "bbl string, version string, lotfront string"))
    assert rows(lots, "bbl", "lotfront", "landuse") == [("1", None, None), ("2", 30.5, None)]
    readers.check_single_version(lots)
    two = lots.unionByName(lots.withColumn("version", F.lit("25v1")))
    with pytest.raises(ValueError, match="version"):
        readers.check_single_version(two)
    assert {r["version"] for r in readers.latest_snapshot(two).collect()} == {"25v1"}


def lines(spark, data):
    return spark.createDataFrame(data, "month string, k bigint, v string")


def test_versions_dead_writer_is_never_seen(spark, tmp_path, monkeypatch):
    path, months = str(tmp_path / "s"), ["2020-05", "2020-06"]
    versions.replace_months(spark, path, lines(spark, [("2020-05", 1, "a"), ("2020-06", 2, "b")]), months, NOW, ["k"])
    snapshot = readers.read_store(spark, path)

    def dies(*_):
        raise RuntimeError("writer lost")
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", dies)
        with pytest.raises(RuntimeError):
            versions.replace_months(spark, path, lines(spark, [("2020-05", 9, "half")]), months, NOW)
        with pytest.raises(RuntimeError):
            store.ingest_rows(spark, str(tmp_path / "r"), req(spark, FIRST[:1]), ["2023-01"], NOW)
    assert rows(readers.read_store(spark, path), "k") == [(1,), (2,)]
    assert versions.current(spark, str(tmp_path / "r")) == {}
    # the same pull again goes through, a month without rows is emptied, and an older reader keeps its snapshot
    versions.replace_months(spark, path, lines(spark, [("2020-05", 9, "whole")]), months, NOW)
    assert rows(readers.read_store(spark, path), "month", "k", "v") == [("2020-05", 9, "whole")]
    assert rows(snapshot, "k") == [(1,), (2,)]
    assert rows(versions.superseded(spark, path), "month") == [("2020-05",), ("2020-06",)]
    versions.replace_months(spark, path, lines(spark, []), ["2020-05"], NOW)
    assert readers.read_store(spark, path).columns == ["k", "v", "month"] and readers.read_store(spark, path).collect() == []


def test_versions_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    versions.replace_months(spark, path, lines(spark, [("2020-05", 1, "a")]), ["2020-05"], NOW)
    base = versions.current(spark, path)
    mine = versions.write_pull(lines(spark, [("2020-05", 2, "mine")]), path)
    other = lines(spark, [("2020-05", 3, "other")])
    versions.replace_months(spark, path, other, ["2020-05"], NOW)
    with pytest.raises(ValueError, match="meanwhile"):
        versions.publish(spark, path, mine, other.schema, ["2020-05"], base, NOW)
    # months that the other one did not touch go through
    june = versions.write_pull(lines(spark, [("2020-06", 4, "june")]), path)
    versions.publish(spark, path, june, other.schema, ["2020-06"], base, NOW)
    assert rows(readers.read_store(spark, path), "k") == [(3,), (4,)]


def test_versions_keep_columns_that_a_later_pull_lacks(spark, tmp_path):
    path = str(tmp_path / "s")
    full = req(spark, FIRST)
    store.ingest_rows(spark, path, full, ["2023-01", "2023-02", "2023-03"], NOW)
    done = store.ingest_rows(spark, path, full.drop("status").where("unique_key = '2'"), ["2023-02"], NOW)
    assert rows(done, "month", "fetched", "updated") == [("2023-02", 1, 0)]
    extra = full.where("unique_key = '3'").withColumn("borough", F.lit("east"))
    store.ingest_rows(spark, path, extra, ["2023-03"], NOW)
    got = readers.read_store(spark, path)
    assert rows(got, "unique_key", "status", "borough") == [("1", "Open", None), ("2", None, None), ("3", "Open", "east")]


def test_versions_list_only_the_folders_of_the_months(spark, tmp_path):
    path, months = str(tmp_path / "s"), [f"2020-{m:02d}" for m in range(1, 7)]
    versions.replace_months(spark, path, lines(spark, [(m, k, "x") for k, m in enumerate(months)]), months, NOW)
    files = readers.read_store(spark, path, months=["2020-02", "2020-09"]).inputFiles()
    assert files and all("month=2020-02" in f for f in files)
    with pytest.raises(AnalysisException):
        readers.read_store(spark, str(tmp_path / "nothing"))


NEWER = "started_at,ended_at,start_lat,start_lng,end_lat,end_lng"
OLDER = '"StartTime","stoptime"," start station latitude","start station longitude","end station latitude","end station longitude","note"'


def test_trip_files_take_the_same_jobs_however_many(spark, tmp_path):
    def jobs(count):
        folder = tmp_path / f"trips {count}"
        folder.mkdir()
        want = 0
        for k in range(count):
            body = [f"2021-03-0{1 + r} 10:00:00,2021-03-0{1 + r} 10:10:00,40.{k % 10}1,-74.0,40.72,-73.9" for r in range(k % 4)]
            want += len(body)
            old = k % 2
            (folder / f"part {k}+{old}.csv").write_text("\n".join([OLDER if old else NEWER, *(b + (',"a, b"' if old else "") for b in body)]) + "\n")
        (folder / "empty.csv").write_text("")
        spark.sparkContext.setJobGroup(f"trips-{count}", "trips")
        try:
            trips = readers.read_trips(spark, [str(folder)])
            got = trips.count()
        finally:
            spark.sparkContext.setJobGroup("rest", "rest")
        assert got == want and trips.columns == ["started", "ended", "start_lat", "start_lng", "end_lat", "end_lng"]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trips-{count}"))
    assert jobs(4) == jobs(24)
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="layout"):
        readers.read_trips(spark, [str(tmp_path / "odd.csv")])
