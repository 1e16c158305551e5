from datetime import date

from pyspark.sql import functions as F

from harborwatch.functions import fields as f
from harborwatch.operators import features as ft
from harborwatch.schema import ATTACK_FIELDS, CONN_FIELDS, CONNECTION_STATES, FEATURES, MODEL_FEATURES, Params
from harborwatch.sources import conn_log, tables
from tests.helpers import DAY0, conn_frame

P = Params()


def test_schema_sizes():
    assert len(CONN_FIELDS) == 20 and len(ATTACK_FIELDS) == 21 and len(CONNECTION_STATES) == 13
    assert len(FEATURES) == 39 and len(MODEL_FEATURES) == 35
    assert (P.tw_per_day, P.offset_tw) == (1440, 720)


def _line(*values):
    return "\t".join(values)


def test_log_text_with_comments_short_and_unset_fields(spark, tmp_path):
    full = ["10.5", "C1", "147.32.0.1", "5000", "8.8.8.8", "80", "tcp", "-", "0.25", "-", "0", "SF", "T", "F", "0", "S",
            "3", "120", "2", "80", "(empty)"]
    other = full.copy()
    other[5], other[1] = "8080", "C2"
    text = ["#separator \\x09"] + ["#x"] * 7 + [_line(*full), _line(*other), _line("11", "C3", "a", "1", "b", "22"), "#close"]
    (tmp_path / "conn.log").write_text("\n".join(text) + "\n")
    (tmp_path / "ignored.txt").write_text(_line(*full) + "\n")
    rows = {r.uid: r for r in conn_log.scan_conn_log(spark, str(tmp_path)).collect()}
    assert set(rows) == {"C1", "C2", "C3"}
    assert (rows["C1"].ts, rows["C1"].duration, rows["C1"].orig_bytes, rows["C1"].resp_bytes) == (10.5, 0.25, None, 0.0)
    assert rows["C1"].service is None and rows["C1"].resp_ip_bytes == 80.0
    # The last field of a line is dropped, so the short record has no port.
    assert rows["C3"].orig_p == 1 and rows["C3"].resp_h == "b" and rows["C3"].resp_p is None
    kept = ft.port_prefilter(conn_log.scan_conn_log(spark, str(tmp_path)), P)
    assert [r.uid for r in kept.collect()] == ["C1"]


def test_attack_log_keeps_the_last_field(spark, tmp_path):
    values = [str(i) for i in range(20)] + ["(empty)"]
    (tmp_path / "conn.log").write_text("#a\n" + _line(*values) + "\n#close\n")
    row = conn_log.scan_attack_log(spark, str(tmp_path / "conn.log")).first()
    assert row.tunnel_parents == "(empty)" and row.resp_ip_bytes == 19.0


def test_day_split_reads_only_the_asked_day(spark, tmp_path):
    conns = conn_frame(spark, [{"ts": DAY0 + 10}, {"ts": DAY0 + 86400 + 5}, {"ts": DAY0, "resp_p": 9}])
    conn_log.split_by_day(conns, P, str(tmp_path / "d"))
    table = conn_log.scan_day(spark, str(tmp_path / "d"), ["2024-01-02"])
    assert table.count() == 1 and table.first().day == date(2024, 1, 2)
    assert "PartitionFilters: [isnotnull(day" in table._jdf.queryExecution().toString()


def test_shifted_split_stores_the_wall_clock(spark, tmp_path):
    zone = Params(report_tz="US/Eastern")
    conn_log.split_by_day(conn_frame(spark, [{"ts": DAY0 + 3600}]), zone, str(tmp_path / "d"), shift_ts=True)
    row = conn_log.scan_day(spark, str(tmp_path / "d")).first()
    assert row.day == date(2023, 12, 31) and row.ts == DAY0 + 3600 - 5 * 3600


def test_range_filter_on_ts_is_pushed_down(spark, tmp_path):
    conn_frame(spark, [{"ts": DAY0 + i * 40000} for i in range(5)]).write.parquet(str(tmp_path / "t"))
    kept = ft.day_filter(spark.read.parquet(str(tmp_path / "t")), date(2024, 1, 1), P)
    plan = kept._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert kept.count() == 3


def test_importance_files_by_name_and_by_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "port22.csv").write_text("S0_count        0.2500\nnum_conns  0.1\n")
    (tmp_path / "a" / "port443.csv").write_text("S0_count        0.5\n")
    got = {(r.port, r.feature): r.weight for r in tables.scan_importance(spark, str(tmp_path / "a")).collect()}
    assert got == {(22, "S0_count"): 0.25, (22, "num_conns"): 0.1, (443, "S0_count"): 0.5}
    table = spark.createDataFrame([(22, "a", 0.2), (22, "b", 0.7), (80, "a", 0.1)], "port int, feature string, weight double")
    for _ in range(2):  # a second run replaces the files
        tables.sink_importance(table, str(tmp_path / "b"))
    assert tables.scan_importance(spark, str(tmp_path / "b")).count() == 3
    lines = [r.value for r in spark.read.text(str(tmp_path / "b" / "port=22")).collect()]
    assert [x.split() for x in lines] == [["b", "0.7000"], ["a", "0.2000"]]


def test_models_of_two_runs_share_a_path(spark, tmp_path):
    a = spark.createDataFrame([(22, 1.0)], "port int, h double")
    tables.sink_model(a, str(tmp_path / "m"), "one")
    tables.sink_model(a.withColumn("h", F.lit(2.0)), str(tmp_path / "m"), "two")
    assert tables.scan_model(spark, str(tmp_path / "m"), "one").first().h == 1.0
    assert tables.scan_model(spark, str(tmp_path / "m"), "two").first().h == 2.0


def test_address_helpers(spark):
    ips = ["8.8.8.8", "10.1.2.3", "172.31.0.1", "172.32.0.1", "100.64.0.1", "192.0.0.170", "192.0.0.8", "255.255.255.255", "224.0.0.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    number = f.ip_number(F.col("ip"))
    got = {r.ip: (r.g, r.back) for r in df.select("ip", f.is_global(number).alias("g"), f.ip_text(number).alias("back")).collect()}
    assert {k for k, v in got.items() if v[0]} == {"8.8.8.8", "172.32.0.1", "192.0.0.8", "224.0.0.1"}
    assert all(k == v[1] for k, v in got.items())


def test_later_ingests_keep_earlier_days_and_variants(spark, tmp_path):
    for n in (0, 1):
        conn_log.split_by_day(conn_frame(spark, [{"ts": DAY0 + n * 86400 + i} for i in range(5)]), P, str(tmp_path / "days"))
    days = conn_log.scan_day(spark, str(tmp_path / "days")).groupBy("day").count().collect()
    assert sorted((r.day.day, r["count"]) for r in days) == [(1, 5), (2, 5)]
    for name in ("a", "b"):
        conn_log.sink_prepared(conn_frame(spark, [{}]).withColumn("variant", F.lit(name)), str(tmp_path / "traces"))
    assert {r.variant for r in conn_log.scan_prepared(spark, str(tmp_path / "traces")).collect()} == {"a", "b"}


def test_importance_path_and_large_weights(spark, tmp_path):
    folder = tmp_path / "report2024" / "port9"
    folder.mkdir(parents=True)
    (folder / "port22.csv").write_text("num_conns 0.5\n")
    assert [r.port for r in tables.scan_importance(spark, str(folder)).collect()] == [22]
    table = spark.createDataFrame([(80, "num_conns", 12345.5)], "port int, feature string, weight double")
    tables.sink_importance(table, str(tmp_path / "port3out"))
    assert [tuple(r) for r in tables.scan_importance(spark, str(tmp_path / "port3out")).collect()] == [(80, "num_conns", 12345.5)]


def test_random_public_ip_covers_all_ranges_evenly(spark):
    assert f.GLOBAL_ADDRESSES == (1 << 32) - sum(
        n.num_addresses for n in f.ipaddress.collapse_addresses(map(f.ipaddress.ip_network, f.NON_GLOBAL_RANGES)))
    low = spark.range(20000).select(f.ip_number(f.random_public_ip("s", F.col("id").cast("string"))).alias("n"))
    share = low.filter("n < 2147483648").count() / 20000
    below = sum(b - a for a, b in ((g, g + n - e) for (g, e), (_, n) in zip(f.GLOBAL_RANGES, f.GLOBAL_RANGES[1:])) if a < 1 << 31)
    assert abs(share - below / f.GLOBAL_ADDRESSES) < 0.02


def test_random_public_ip_is_stable_and_global(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    ip = f.random_public_ip("7", F.col("s"), F.lit("192.168.1.1"))
    out = df.select("s", ip.alias("ip"), f.is_global(f.ip_number(ip)).alias("g"))
    assert out.filter("not g").count() == 0
    assert out.select("ip").distinct().count() > 2990
    assert sorted(out.collect()) == sorted(out.collect())


def test_interval_text(spark):
    df = spark.createDataFrame([("20190611_00:30:00-01:00:00-0400",), ("20190611_23:30:00-00:00:00-0400",),
                                ("20190611_00:30:00-01:00:00+0400",)], "t string")
    rows = [r.i for r in df.select(f.interval_to_utc(F.col("t")).alias("i")).collect()]
    midnight = f.utc(2019, 6, 11)
    assert (rows[0].start_utc, rows[0].end_utc) == (midnight + 4.5 * 3600, midnight + 5 * 3600)
    assert (rows[0].start_local, rows[0].end_local) == (midnight + 1800, midnight + 3600)
    assert rows[1].end_utc == midnight + 86400 + 4 * 3600 and rows[1].end_local == midnight
    assert rows[2] is None
