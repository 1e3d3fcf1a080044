import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltrail.functions import scalar as S
from voltrail.operators import cleaning as C, reports as R
from voltrail.schema import RAW_HEADERS, STATION
from voltrail.session import scratch_path
from voltrail.sources import readers as IN, sinks as OUT
from voltrail.sources.mapping import long_sessions, sessions


@pytest.mark.parametrize("raw, expected", [
    ("Temperature (°C)", "temperature_degc"),
    ("State of Charge (End %)", "state_of_charge_end_pct"),
    (" A/B ", "a_per_b"),
    ("Distance Driven (since last charge) (km)", "distance_driven_since_last_charge_km"),
])
def test_header_rule(raw, expected):
    assert C.standard_name(raw) == expected


def test_bands(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.1, 6), (10.0, 7), (31.0, 12), (None, 18), (20.0, 23)], "t double, h int")
    found = rows.select(S.temperature_band("t"), S.start_hour_bin("h")).collect()
    assert [r[0] for r in found] == ["freezing", "cold", "cold", "hot", "unknown", "mild"]
    assert [r[1] for r in found] == ["overnight", "overnight", "morning", "morning", "afternoon", "evening"]


def test_ratio_and_clip_keep_nulls(spark):
    rows = spark.createDataFrame([(100.0, 0.0), (100.0, None), (100.0, 10.0), (None, 10.0)], "e double, c double")
    assert [r[0] for r in rows.select(S.energy_to_capacity("e", "c")).collect()] == [0.0, 0.0, 5.0, None]
    temps = spark.createDataFrame([(None,), (20.0,), (90.0,)], "t double")
    assert [r[0] for r in temps.select(S.humidity_proxy("t")).collect()] == [None, 100.0, 0.0]


def test_null_keys(spark):
    rows = spark.createDataFrame(
        [(None, "u1", dt.datetime(2024, 1, 1), 1.0, 1.0), ("s", None, dt.datetime(2024, 1, 1), 2.0, 3.0)],
        f"{STATION} string, user_id string, charging_start_time timestamp_ntz, energy_consumed_kwh double, "
        "charging_duration_minutes double",
    )
    assert [tuple(r) for r in R.daily_agg(rows).collect()] == [("s", dt.date(2024, 1, 1), 0, 2.0, 3.0)]
    assert {r[STATION]: r["sessions"] for r in R.station_demand(rows).collect()} == {None: 1, "s": 1}


def test_peak_hour_tie_takes_the_smallest(spark):
    hours = spark.createDataFrame([(3,), (1,), (3,), (1,)], "start_hour int")
    assert tuple(R.peak_hour(hours).first()) == (1, 2)


def test_load_clean_from_csv(spark, tmp_path):
    values = dict.fromkeys(RAW_HEADERS, "x")
    values |= {
        "Battery Capacity (kWh)": "bad", "Energy Consumed (kWh)": "12.5", "Charging Duration (hours)": "1.5",
        "Charging Start Time": "2024-01-06 23:10:05.123456", "Charging End Time": "2024-01-07 00:40:05",
        "Charging Rate (kW)": "NA", "User Type": "",
    }
    dropped = values | {"Energy Consumed (kWh)": "none at all"}
    path = str(tmp_path / "raw.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(RAW_HEADERS) + "\n")
        for row in (values, dropped):
            f.write(",".join(row[h] for h in RAW_HEADERS) + "\n")
    rows = IN.load_clean(spark, path, RAW_HEADERS).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["battery_capacity_kwh"] is None and row["charging_rate_kw"] is None and row["user_type"] is None
    assert row["charging_start_time"] == dt.datetime(2024, 1, 6, 23, 10, 5, 123456)
    assert (row["start_hour"], row["day_of_week"], row["charging_duration_minutes"]) == (23, "Saturday", 90.0)


def test_columns_follow_the_header_row(spark, tmp_path):
    path = str(tmp_path / "other.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("Charging Duration (hours),User ID,Extra\n2.0,u1,x\nbad,u2,y\n")
    assert [tuple(r) for r in IN.load_clean(spark, path).drop("row_id").collect()] == [(2.0, "u1", "x", 120.0)]
    with pytest.raises(Exception, match="(?i)header"):
        IN.load_raw(spark, path, ["User ID", "Charging Duration (hours)", "Extra"]).collect()


def test_missing_files_and_bad_input_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        IN.load_raw(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        IN.read_daily(spark, str(tmp_path / "none.csv"))
    with pytest.raises(Exception, match="(?i)cast"):
        C.parse_times(spark.createDataFrame([("not a time",)], "charging_start_time string")).collect()
    with pytest.raises(ValueError, match="absent"):
        C.require_columns(spark.range(1).withColumn("y", F.lit(1.0)), ["id", "absent"], "y")
    with pytest.raises(ValueError, match="station_id=s"):
        R.station_series_filter(spark.createDataFrame([], f"{STATION} string"), "s")


def test_date_filter_reaches_the_scan(spark, sf_dir):
    plan = C.date_range_filter(
        long_sessions(spark, sf_dir).select("row_id", "charging_start_time"), dt.date(1996, 1, 1), dt.date(1996, 2, 1)
    )._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_station_filter_forms_agree(spark, sf_dir):
    df = sessions(spark, sf_dir).select("row_id", STATION)
    few = [f"Station_{i}" for i in range(40)]
    many = few + [f"Nowhere_{i}" for i in range(300)]
    assert C.station_filter(df, few).count() == C.station_filter(df, many).count() > 0
    assert C.station_filter(df, ["All", "Station_1"]).count() == C.station_filter(df, None).count() == df.count()


def test_daily_is_read_when_stored_and_rebuilt_else(spark, sf_dir):
    df = sessions(spark, sf_dir)
    path = OUT.write_parquet(R.daily_agg(df), scratch_path(spark, "daily"), partition_by="session_date")
    stored = IN.daily_or_rebuild(spark, path, df)
    rebuilt = IN.daily_or_rebuild(spark, path + "-none", df)
    assert stored.exceptAll(rebuilt).isEmpty() and rebuilt.exceptAll(stored).isEmpty()


def test_daily_csv_round_trip_with_and_without_typed_dates(spark, sf_dir):
    daily = R.daily_agg(sessions(spark, sf_dir))
    path = OUT.write_csv(daily, scratch_path(spark, "daily-csv"))
    assert dict(IN.read_daily(spark, path).dtypes)["session_date"] == "date"
    assert dict(IN.read_daily(spark, path, parse_dates=False).dtypes)["session_date"] == "string"
    assert IN.read_daily(spark, path).exceptAll(daily).isEmpty()


def test_managed_table_is_replaced(spark):
    OUT.register_table(spark.range(3), "voltrail_test_view")
    assert OUT.register_table(spark.range(5), "voltrail_test_view").count() == 5


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from voltrail import session

    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_files_with_another_column_order(spark, tmp_path):
    write(tmp_path / "a.csv", "Energy Consumed (kWh),Charging Duration (hours)\n1.0,10\n2.0,20\n")
    write(tmp_path / "b.csv", "Charging Duration (hours),Energy Consumed (kWh),User ID\n30,3.0,u\n")
    glob = str(tmp_path / "*.csv")
    with pytest.raises(Exception, match="(?i)header"):
        IN.load_raw(spark, glob).collect()
    rows = IN.load_clean(spark, glob, by_name=True).orderBy("row_id").collect()
    assert [(r["row_id"], r["energy_consumed_kwh"], r["charging_duration_hours"], r["user_id"]) for r in rows] == [
        (0, 1.0, 10.0, None), (1, 2.0, 20.0, None), (2, 3.0, 30.0, "u")]


def test_quoted_cells(spark, tmp_path):
    write(tmp_path / "q.csv", 'id,t\n1,"a ""b"", c"\n2,"x\ny"\n')
    assert [tuple(r) for r in IN.load_raw(spark, str(tmp_path / "q.csv"), multi_line=True).collect()] == [("1", 'a "b", c'), ("2", "x\ny")]
    path = OUT.write_csv(spark.createDataFrame([(1, 'say "hi", now')], "id int, t string"), str(tmp_path / "out"))
    assert [tuple(r) for r in IN.load_raw(spark, path).collect()] == [("1", 'say "hi", now')]
    import glob as files
    import pandas
    assert pandas.concat(map(pandas.read_csv, files.glob(f"{path}/part-*.csv")))["t"].tolist() == ['say "hi", now']


def test_only_numbers_are_numbers(spark):
    cells = ["12", " 1.5 ", "-.5", "1e3", "12d", "12f", "0x1", "1,2", "", "1_000", "inf", None]
    df = spark.createDataFrame([(c,) for c in cells], "temperature_degc string")
    assert [r[0] for r in C.coerce_numeric(df).collect()] == [12.0, 1.5, -0.5, 1000.0, None, None, None, None, None, None, float("inf"), None]


def test_only_an_absent_path_counts_as_absent(spark, tmp_path):
    assert not IN.path_exists(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception):
        IN.path_exists(spark, "nosuchscheme://host/x")


def test_row_numbers_follow_files_and_lines(spark, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        write(tmp_path / f"{name}.csv", "Energy Consumed (kWh),Charging Duration (hours)\n" + "".join(f"{first + i},1\n" for i in range(50)))
    rows = IN.load_clean(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(100))
    assert [r["energy_consumed_kwh"] for r in rows] == [float(i) for i in (*range(50), *range(100, 150))]


def test_places_of_an_ordered_table(spark):
    from voltrail.operators.joins import numbered
    rows = numbered(spark.range(500).repartition(7).orderBy("id")).collect()
    assert all(r["place"] == r["id"] + 1 for r in rows)


def test_local_files_are_refused_on_a_cluster():
    from voltrail import session

    class Context:
        master = "yarn"

        @staticmethod
        def getConf():
            return {"spark.checkpoint.dir": "file:///tmp/x"}

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="cannot see"):
        session.shared_dir(Session)
