import json

from pyspark.sql import functions as F

from tidemark.sources import archive, history, log


def test_daily_history(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STATION,NAME,DATE,TMAX,TMIN,TAVG,AWND,PRCP,OTHER\nS,N,2020-01-02,40,20,,x,0.1,1\nS,N,2020-01-01,30,10,25,5,,2\nS,N,2020-01-03,,,,7,0.3,3\n")
    got = history.daily_history(spark, str(tmp_path / "a.csv")).collect()
    assert [str(r["date"]) for r in got] == ["2020-01-01", "2020-01-02", "2020-01-03"]
    assert [r["temp_avg"] for r in got] == [25.0, 30.0, 27.5]
    assert [r["wind_speed"] for r in got] == [5.0, 6.0, 7.0] and "OTHER" not in got[0].asDict() and got[0]["day_of_week"] == 2


def test_hourly_normals_has_leap_day(spark, tmp_path):
    (tmp_path / "n.csv").write_text("DATE,HLY-TEMP-NORMAL,HLY-DEWP-NORMAL,HLY-WIND-AVGSPD\n02-29T01:00:00,30,20,5\n01-01T00:00:00,10,,x\nbad,1,1,1\n03-01T00:00:00,,5,5\n")
    got = history.hourly_normals(spark, str(tmp_path / "n.csv")).collect()
    assert len(got) == 2 and str(got[1]["date"]) == "2012-02-29 01:00:00"
    assert got[1]["humidity"] == 50.0 and got[0]["wind_speed"] == 5.0


def test_chunks_and_payloads(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"metadata": {"station_name": "N", "chunk_index": i}, "records": [{"date": "d", "value": "1"}] * (i + 1)}, indent=1))
    assert history.climate_chunks(spark, str(tmp_path)).count() == 3
    payload = json.dumps({"timestamp": "2025-12-13T09:50:00+00:00", "temperature": {"value": 3.24}, "barometricPressure": {"value": 101325}, "windSpeed": {"value": None}, "relativeHumidity": {"value": 71.234}})
    df = spark.createDataFrame([("s", payload), ("t", "{broken")], "station string, p string")
    got = {r["station_id"]: r for r in history.observations(df, "p", "station").collect()}
    assert got["s"]["temperature"] == 3.2 and got["s"]["sea_level_pressure"] == 1013.25 and got["s"]["precipitation_last_hour"] == 0.0 and got["s"]["wind_speed"] is None
    assert got["t"]["temperature"] is None
    assert history.observations(df, "p", "station", units="imperial").where("station_id = 's'").first()["temperature"] == 37.8


def test_forecast_periods(spark):
    p = json.dumps([{"startTime": "2025-12-13T09:00:00+00:00", "temperature": 30, "windSpeed": "10 mph", "relativeHumidity": {"value": 50}}, {"startTime": "2025-12-13T10:00:00+00:00", "temperature": 31, "windSpeed": "calm"}])
    got = history.forecast_periods(spark.createDataFrame([("s", p)], "station string, p string"), "p", "station").orderBy("start").collect()
    assert [r["wind_speed"] for r in got] == [10.0, None] and got[1]["precipitation_probability"] == 0.0


def test_decode_malformed_and_encode_round_trip(spark):
    raw = spark.createDataFrame([("k", '{"a": 1}', 0), ("k", "{bad", 1), ("k", None, 2)], "key string, value string, partition int")
    assert [r["a"] for r in log.decode(raw, "a long").orderBy("partition").collect()] == [1, None, None]
    df = spark.sql("select 'x' as k, timestamp'2024-01-01 00:00:00' as t, cast(null as double) as v, 1.5 as w")
    assert json.loads(log.encode(df, "k").first()["value"]) == {"k": "x", "t": "2024-01-01 00:00:00", "w": 1.5}


def test_audit_counts_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"station_id": "a"}\nnot json\n')
    r = archive.audit(spark, str(tmp_path)).first()
    assert (r["lines"], r["valid"], r["invalid"]) == (2, 1, 1)


def test_csv_sink_and_missing_connector(spark, tmp_path):
    history.write_csv(spark.range(3).withColumn("x", F.lit("a,b")), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).where("x = 'a,b'").count() == 3
    assert log.has_broker_connector(spark) in (True, False)
