"""Sources, sinks and scalar expressions (S*, P*)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks import fixtures as x
from checks import sql as q
from checks.registry import query, rounded
from harborwatch.functions import fields as f
from harborwatch.operators import attack, features, history, scaling
from harborwatch.schema import ATTACK_FIELDS, CONN_FIELDS, FEATURES, MODEL_FEATURES, Params, column_name
from harborwatch.session import work_path
from harborwatch.sources import conn_log, tables

P = x.PARAMS_60
CONN_COLS = "uid, ts, resp_p, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, conn_state, orig_h, resp_h"


def _text_fields(rows, fields):
    return [F.coalesce(F.col(column_name(n)).cast("string"), F.lit("-")) if column_name(n) in rows.columns
            else F.lit("-") for n in fields]


def _log_lines(rows, fields, tail=()):
    """Tab-separated log text of the rows, one comment line for every third record."""
    line = F.concat_ws("\t", *_text_fields(rows, fields), *[F.lit(t) for t in tail])
    comment = F.when(F.col("uid").cast("long") % 3 == 0, F.concat(F.lit("#fields\t"), F.col("uid")))
    return rows.select(F.explode(F.array_compact(F.array(comment, line))).alias("value"))


def _conn_log_dir(spark, sf_dir):
    path = work_path(spark, "conn-log")
    _log_lines(x.conn(spark, sf_dir), CONN_FIELDS, tail=["(empty)"]).write.text(f"{path}/whole.log")
    return path


def _scan_conn(spark, sf_dir):
    return conn_log.scan_conn_log(spark, _conn_log_dir(spark, sf_dir))


@query("scan_conn_log", q.with_(q.conn(), f"SELECT {CONN_COLS} FROM conn"))
def scan_conn_log(spark, sf_dir):
    return _scan_conn(spark, sf_dir).select(*CONN_COLS.split(", "))


@query("port_prefilter", q.with_(q.conn(), f"SELECT {CONN_COLS} FROM conn WHERE resp_p IN {q.PORTS}"))
def port_prefilter(spark, sf_dir):
    return features.port_prefilter(x.conn(spark, sf_dir), P).select(*CONN_COLS.split(", "))


@query("split_by_day", q.with_(q.conn(), f"""
    SELECT cast(make_timestamp(cast(round(ts * 1e6) AS bigint)) AS date) AS day, count(*) AS n,
           round(sum(orig_bytes), 6) AS orig_bytes FROM conn WHERE resp_p IN {q.PORTS} GROUP BY 1"""))
def split_by_day(spark, sf_dir):
    path = work_path(spark, "by-day")
    conn_log.split_by_day(x.conn(spark, sf_dir), P, path)
    table = spark.read.parquet(path)
    return table.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("orig_bytes"), 6).alias("orig_bytes"))


@query("scan_day_csv", q.with_(q.conn(), f"""
    SELECT {CONN_COLS} FROM conn WHERE resp_p IN {q.PORTS}"""))
def scan_day_csv(spark, sf_dir):
    path = work_path(spark, "by-day-csv")
    conn_log.split_by_day(conn_log.reindex_cols(x.conn(spark, sf_dir)).drop("tunnel_parents"), P, path, fmt="csv")
    return conn_log.scan_day(spark, path, fmt="csv").select(*CONN_COLS.split(", "))


@query("scan_attack_log", q.with_(q.attack_raw(), f"SELECT {CONN_COLS} FROM attack_raw"))
def scan_attack_log(spark, sf_dir):
    path = work_path(spark, "attack-log")
    _log_lines(x.attack_raw(spark, sf_dir), ATTACK_FIELDS).write.text(path)
    return conn_log.scan_attack_log(spark, path).select(*CONN_COLS.split(", "))


@query("scan_prepared", q.with_(q.attack(), f"SELECT 'wannacry' AS variant, {CONN_COLS} FROM attack"))
def scan_prepared(spark, sf_dir):
    path = work_path(spark, "prepared")
    conn_log.sink_prepared(prepared(spark, sf_dir), path)
    return conn_log.scan_prepared(spark, path).select("variant", *CONN_COLS.split(", "))


def prepared(spark, sf_dir):
    return attack.prepare_attack(x.attack_raw(spark, sf_dir), x.PARAMS_OVERLAY)


def window_features(spark, sf_dir, p=x.PARAMS_3600):
    return features.window_features(x.conn(spark, sf_dir), p, x.BASE_DAY)


@query("scan_features", q.with_(q.features(3600), q.rounded_features("day, timewindow, port", "features")))
def scan_features(spark, sf_dir):
    path = work_path(spark, "features")
    tables.sink_features(window_features(spark, sf_dir), path)
    return rounded(tables.scan_features(spark, path).select("day", "timewindow", "port", *FEATURES))


@query("sink_features", q.with_(q.features(3600), q.rounded_features("day, timewindow, port", "features")))
def sink_features(spark, sf_dir):
    path = work_path(spark, "features-csv")
    tables.sink_features(window_features(spark, sf_dir), path, fmt="csv")
    return rounded(tables.scan_features(spark, path, fmt="csv").select("day", "timewindow", "port", *FEATURES))


STATE_SHARE = """SELECT port, feature, round(avg(x), 4) AS weight FROM ({long}) l GROUP BY port, feature"""


def _state_weights(spark, sf_dir):
    """A weight per (port, feature) that the data decides: the mean feature value."""
    long = scaling.unpivot_features(window_features(spark, sf_dir), ["port"])
    return long.groupBy("port", "feature").agg(F.round(F.avg("x"), 4).alias("weight"))


_WEIGHTS_SQL = q.with_(q.features(3600), STATE_SHARE.format(long=q.long("features", "port")))


@query("scan_importance", _WEIGHTS_SQL)
def scan_importance(spark, sf_dir):
    path = work_path(spark, "importance")
    weights = _state_weights(spark, sf_dir)
    lines = weights.select("port", F.concat_ws("    ", "feature", F.col("weight").cast("string")).alias("value"))
    lines.repartition("port").write.partitionBy("port").text(path)
    return tables.scan_importance(spark, path).select("port", "feature", "weight")


@query("sink_importance", q.with_(q.features(3600), f"""
    SELECT port, feature, round(weight / (1 + max(weight) OVER (PARTITION BY port)), 4) AS weight
    FROM ({STATE_SHARE.format(long=q.long("features", "port"))}) w"""))
def sink_importance(spark, sf_dir):
    path = work_path(spark, "importance")
    weights = _state_weights(spark, sf_dir)
    top = weights.groupBy("port").agg(F.max("weight").alias("top"))
    shares = weights.join(top, "port").select("port", "feature", F.round(F.col("weight") / (1 + F.col("top")), 4).alias("weight"))
    tables.sink_importance(shares, path)
    return tables.scan_importance(spark, path).select("port", "feature", "weight")


@query("history_tables", q.with_(q.oriented(60), "SELECT DISTINCT day, port, ext_ip FROM oriented"))
def history_tables(spark, sf_dir):
    path = work_path(spark, "history")
    tables.sink_state(history.history_by_day_port(oriented(spark, sf_dir)), path)
    return tables.scan_history(spark, path).select("day", "port", "ext_ip")


@query("subnet_tables", q.with_(q.oriented(60), r"""
    SELECT DISTINCT day, regexp_extract(int_ip, '^(\d+\.\d+\.\d+\.)', 1) AS subnet24, int_ip FROM oriented"""))
def subnet_tables(spark, sf_dir):
    path = work_path(spark, "subnets")
    tables.sink_state(history.subnet_hosts(oriented(spark, sf_dir)), path)
    return tables.scan_subnet_hosts(spark, path).select("day", "subnet24", "int_ip")


@query("model_tables", q.with_(q.train(3600), "SELECT port, feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM scaler"))
def model_tables(spark, sf_dir):
    path = work_path(spark, "models")
    tables.sink_model(scaling.scaler_fit(training_windows(spark, sf_dir), x.PARAMS_3600), path, "kde-3600")
    return rounded(tables.scan_model(spark, path, "kde-3600").select("port", "feature", "lo", "hi"))


@query("result_sinks", q.with_(q.features(3600), """
    SELECT day, port, max(num_conns) AS top, round(max(mean_duration), 6) AS mean FROM features GROUP BY day, port"""))
def result_sinks(spark, sf_dir):
    path = work_path(spark, "result")
    report = window_features(spark, sf_dir).groupBy("day", "port").agg(
        F.max("num_conns").alias("top"), F.round(F.max("mean_duration"), 6).alias("mean"))
    tables.sink_result(report, path)
    return tables.scan_result(spark, path, "day date, port int, top bigint, mean double")


def training_windows(spark, sf_dir, p=x.PARAMS_3600, ports=Params().model_ports):
    table = window_features(spark, sf_dir, p)
    return table.filter((F.col("day") < F.lit(x.TEST_DAY)) & F.col("port").isin(list(ports)))


def oriented(spark, sf_dir, p=P):
    return features.profiled_connections(x.conn(spark, sf_dir), p)


# --- scalar expressions ----------------------------------------------------------

@query("null_dash", q.with_(q.conn(), "SELECT uid, duration, resp_bytes FROM conn"))
def null_dash(spark, sf_dir):
    text = x.conn(spark, sf_dir).select("uid", *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("duration", "resp_bytes")])
    return text.select("uid", *[f.measure(F.col(c)).alias(c) for c in ("duration", "resp_bytes")])


@query("drop_ipv6", q.with_(q.conn(), "SELECT uid, orig_h, resp_h FROM conn WHERE orig_h NOT LIKE '%:%'"))
def drop_ipv6(spark, sf_dir):
    return features.drop_ipv6(x.conn(spark, sf_dir), P).select("uid", "orig_h", "resp_h")


@query("day_filter", q.with_(q.conn(), """
    SELECT uid, ts FROM conn WHERE cast(make_timestamp(cast(round(ts * 1e6) AS bigint)) AS date) = DATE '2024-01-15'"""))
def day_filter(spark, sf_dir):
    return features.day_filter(x.conn(spark, sf_dir), date(2024, 1, 15), P).select("uid", "ts")


@query("time_window", q.with_(q.conn(), """
    SELECT uid, cast(moment AS date) AS day, cast(floor((hour(moment) * 3600 + minute(moment) * 60 + second(moment)) / 60) AS int) AS timewindow
    FROM (SELECT uid, timezone('US/Eastern', timezone('UTC', make_timestamp(cast(round(ts * 1e6) AS bigint)))) AS moment FROM conn) c"""))
def time_window(spark, sf_dir):
    rows = features.with_time_window(x.conn(spark, sf_dir), Params(report_tz="US/Eastern"))
    return rows.select("uid", "day", "timewindow")


@query("attack_window", q.with_(q.attack(), """
    SELECT uid, cast(floor(floor(ts) / 60) AS bigint) AS seq,
           cast(floor((cast(floor(ts) AS bigint) % 86400) / 60) AS int) + 720 AS timewindow FROM attack"""))
def attack_window(spark, sf_dir):
    return attack.attack_window(prepared(spark, sf_dir), x.PARAMS_OVERLAY).select("uid", "seq", "timewindow")


@query("orient_endpoints", q.with_(q.oriented(60), "SELECT uid, int_ip, ext_ip FROM oriented"))
def orient_endpoints(spark, sf_dir):
    return oriented(spark, sf_dir).select("uid", "int_ip", "ext_ip")


@query("attack_endpoints", q.with_(q.placed(60), "SELECT timewindow, int_ip, ext_ip, count(*) AS n FROM placed GROUP BY ALL"))
def attack_endpoints(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("timewindow", "int_ip", "ext_ip").agg(F.count(F.lit(1)).alias("n"))


def mapping(spark, sf_dir, p=x.PARAMS_OVERLAY):
    from harborwatch.plans.overlay import attacker_mapping

    return attacker_mapping(x.conn(spark, sf_dir), x.TEST_DAY, p)


def placed(spark, sf_dir, p=x.PARAMS_OVERLAY):
    return attack.place_attack(prepared(spark, sf_dir), mapping(spark, sf_dir, p), x.TEST_DAY, p)


@query("subnet24", q.with_(q.oriented(60), r"SELECT uid, regexp_extract(ext_ip, '^(\d+\.\d+\.\d+\.)', 1) AS subnet FROM oriented"))
def subnet24(spark, sf_dir):
    return oriented(spark, sf_dir).select("uid", f.subnet24(F.col("ext_ip")).alias("subnet"))


@query("subnet16", q.with_(q.oriented(60), r"SELECT uid, regexp_extract(ext_ip, '^(\d+\.\d+\.)', 1) AS subnet FROM oriented"))
def subnet16(spark, sf_dir):
    return oriented(spark, sf_dir).select("uid", f.subnet16(F.col("ext_ip")).alias("subnet"))


_IP_NUMBER = " + ".join(f"cast(split_part(ext_ip, '.', {i + 1}) AS bigint) * {256 ** (3 - i)}" for i in range(4))


@query("in_cidr", q.with_(q.oriented(60), f"SELECT uid, {q.in_cidr(_IP_NUMBER, '203.0.0.0/22')} AS inside FROM oriented"))
def in_cidr(spark, sf_dir):
    number = f.ip_number(F.col("ext_ip"))
    return oriented(spark, sf_dir).select("uid", f.in_cidr(number, "203.0.0.0/22").alias("inside"))


@query("random_public_ip", q.with_(q.attack_raw(), f"SELECT uid, {q.random_ip('7', 'uid', 'resp_h')} AS ip FROM attack_raw"))
def random_public_ip(spark, sf_dir):
    return x.attack_raw(spark, sf_dir).select("uid", f.random_public_ip("7", F.col("uid"), F.col("resp_h")).alias("ip"))


@query("attack_row_filter", q.with_(q.attack(), "SELECT uid, orig_h, resp_p FROM monitored"))
def attack_row_filter(spark, sf_dir):
    return attack.attack_row_filter(x.attack_raw(spark, sf_dir), x.PARAMS_OVERLAY).select("uid", "orig_h", "resp_p")


@query("relative_time", q.with_(q.attack_raw(), """
    SELECT uid, ts - (SELECT min(ts) FROM attack_raw) AS ts FROM attack_raw"""))
def relative_time(spark, sf_dir):
    return attack.relative_time(x.attack_raw(spark, sf_dir)).select("uid", "ts")


@query("failed_flag", q.with_(q.conn(), "SELECT uid, coalesce(conn_state NOT IN ('S1', 'SF'), false) AS failed FROM conn"))
def failed_flag(spark, sf_dir):
    return x.conn(spark, sf_dir).select("uid", f.failed_flag(F.col("conn_state")).alias("failed"))


@query("zero_resp_flag", q.with_(q.conn(), "SELECT uid, coalesce(resp_bytes = 0, false) AS zero FROM conn"))
def zero_resp_flag(spark, sf_dir):
    return x.conn(spark, sf_dir).select("uid", f.zero_resp_flag(F.col("resp_bytes")).alias("zero"))


@query("local_wallclock_shift", q.with_(q.conn(), """
    SELECT uid, round(epoch_us(timezone('US/Eastern', timezone('UTC', make_timestamp(cast(round(ts * 1e6) AS bigint))))) / 1e6, 3) AS ts
    FROM conn"""))
def local_wallclock_shift(spark, sf_dir):
    shifted = f.local_wallclock(F.col("ts"), "US/Eastern")
    return rounded(x.conn(spark, sf_dir).select("uid", shifted.alias("ts")), 3)


@query("epoch_datetime", q.with_(q.conn(), """
    SELECT uid, make_timestamp(cast(round(ts * 1e6) AS bigint)) AS moment, round(ts, 6) AS back FROM conn"""))
def epoch_datetime(spark, sf_dir):
    at = f.epoch_to_timestamp(F.col("ts"))
    rows = x.conn(spark, sf_dir).select("uid", at.alias("moment"), F.round(f.timestamp_to_epoch(at), 6).alias("back"))
    return rows.withColumn("moment", F.col("moment").cast("timestamp_ntz"))


@query("apply_time_offset", q.with_(q.attack(), """
    SELECT uid, ts + 0.5e0 * hi AS ts FROM attack, (SELECT max(ts) AS hi FROM attack) m WHERE ts + 0.5e0 * hi <= hi"""))
def apply_time_offset(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    span = rows.groupBy("variant").agg(F.max("ts").alias("end"))
    moved = rows.join(F.broadcast(span), "variant").withColumn(
        "ts", f.apply_time_offset(F.col("ts"), F.lit(0.0), F.col("end"), 0.5))
    return moved.filter(F.col("ts").isNotNull()).select("uid", "ts")


@query("interval_to_utc", """
    SELECT event_id,
           CASE WHEN event_id % 5 > 0 THEN epoch_us(start_local) / 1e6 + 14400 END AS start_utc,
           CASE WHEN event_id % 5 > 0 THEN epoch_us(end_local) / 1e6 + 14400
                + CASE WHEN event_id % 3 = 0 THEN 86400 ELSE 0 END END AS end_utc,
           CASE WHEN event_id % 5 > 0 THEN epoch_us(start_local) / 1e6 END AS start_local,
           CASE WHEN event_id % 5 > 0 THEN epoch_us(end_local) / 1e6 END AS end_local
    FROM (SELECT event_id, date_trunc('second', ts) AS start_local,
            CASE WHEN event_id % 3 = 0 THEN cast(date_trunc('day', ts) AS timestamp)
                 ELSE cast(date_trunc('day', ts) AS timestamp) + INTERVAL '23:59:30' END AS end_local
          FROM events) e""")
def interval_to_utc(spark, sf_dir):
    """An interval text per event: it runs to midnight or half a minute before; every fifth has a '+' offset."""
    zone = F.when(F.col("event_id") % 5 == 0, "+0400").otherwise("-0400")
    end = F.when(F.col("event_id") % 3 == 0, "00:00:00").otherwise("23:59:30")
    text = F.concat(F.date_format("ts", "yyyyMMdd_HH:mm:ss"), F.lit("-"), end, zone)
    return x.events(spark, sf_dir).select("event_id", f.interval_to_utc(text).alias("i")).select(
        "event_id", "i.start_utc", "i.end_utc", "i.start_local", "i.end_local")


@query("select_features", q.with_(q.features(3600), f"""
    SELECT day, timewindow, port, {', '.join(f'round({c}, 6) AS {c}' if c in q.DOUBLES else c for c in MODEL_FEATURES)} FROM features"""))
def select_features(spark, sf_dir):
    return rounded(scaling.select_features(window_features(spark, sf_dir)))


@query("reindex_cols", q.with_(q.attack_raw(), """
    SELECT ts, uid, orig_h, cast(NULL AS int) AS orig_p, resp_h, resp_p, cast(NULL AS varchar) AS proto,
      cast(NULL AS varchar) AS service, duration, orig_bytes, resp_bytes, conn_state, cast(NULL AS varchar) AS local_orig,
      cast(NULL AS varchar) AS local_resp, cast(NULL AS double) AS missed_bytes, cast(NULL AS varchar) AS history, orig_pkts,
      cast(NULL AS double) AS orig_ip_bytes, resp_pkts, cast(NULL AS double) AS resp_ip_bytes,
      cast(NULL AS varchar) AS tunnel_parents FROM attack_raw"""))
def reindex_cols(spark, sf_dir):
    return conn_log.reindex_cols(x.attack_raw(spark, sf_dir))


@query("unpivot_features", q.with_(q.features(3600), f"""
    SELECT day, timewindow, port, feature, round(x, 6) AS x FROM ({q.long('features', 'day, timewindow, port')}) l"""))
def unpivot_features(spark, sf_dir):
    return rounded(scaling.unpivot_features(window_features(spark, sf_dir), ["day", "timewindow", "port"]))
