"""From connections to one feature row per (day, time window, port)."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.functions import fields as f
from harborwatch.schema import CONNECTION_STATES, FEATURES, MEASURES, Params

KEY = ["day", "timewindow", "port"]


# --- row level ---------------------------------------------------------------

def port_prefilter(conns: DataFrame, p: Params) -> DataFrame:
    return conns.filter(F.col("resp_p").isin(list(p.ports)))


def drop_ipv6(conns: DataFrame, p: Params) -> DataFrame:
    """Only the originator is tested unless ``drop_ipv6_resp`` is set."""
    kept = conns.filter(~f.is_ipv6(F.col("orig_h")))
    return kept.filter(~f.is_ipv6(F.col("resp_h"))) if p.drop_ipv6_resp else kept


def day_filter(conns: DataFrame, day: date, p: Params, days: int = 1) -> DataFrame:
    """Rows of a local day, as a plain range on ``ts`` so that the file scan can use it."""
    return between(conns, *f.day_bounds(day, p.report_tz, days), p)


def between(conns: DataFrame, start: float | None, end: float, p: Params) -> DataFrame:
    """Rows of [start, end) seconds; in a day-split table also the range of its ``day`` folders, which are then not listed."""
    inside = F.col("ts") < end
    if start is not None:
        inside = inside & (F.col("ts") >= start)
    if "day" not in conns.columns:
        return conns.filter(inside)
    local = lambda ts: datetime.fromtimestamp(ts, ZoneInfo(p.report_tz)).date()
    inside = inside & (F.col("day") <= F.lit(local(end - 1e-6)))
    if start is not None:
        inside = inside & (F.col("day") >= F.lit(local(start)))
    return conns.filter(inside)


def with_time_window(conns: DataFrame, p: Params) -> DataFrame:
    return conns.withColumns({
        "day": f.local_day(F.col("ts"), p.report_tz),
        "timewindow": f.time_window(F.col("ts"), p.report_tz, p.tw_seconds),
    })


def orient_endpoints(conns: DataFrame, p: Params) -> DataFrame:
    outbound = F.col("orig_h").startswith(p.internal_prefix)
    return conns.withColumns({
        "int_ip": F.when(outbound, F.col("orig_h")).otherwise(F.col("resp_h")),
        "ext_ip": F.when(outbound, F.col("resp_h")).otherwise(F.col("orig_h")),
    })


def profiled_connections(conns: DataFrame, p: Params) -> DataFrame:
    """Monitored, IPv4-originated connections with day, window and oriented endpoints."""
    rows = with_time_window(drop_ipv6(port_prefilter(conns, p), p), p)
    return orient_endpoints(rows, p).withColumnRenamed("resp_p", "port")


def bad_state_rows(conns: DataFrame) -> DataFrame:
    """How many rows carry a state outside the closed list (they count in no state column)."""
    unknown = F.col("conn_state").isNotNull() & ~F.col("conn_state").isin(CONNECTION_STATES)
    return conns.agg(F.count_if(unknown).alias("bad_rows"))


def require_known_states(conns: DataFrame) -> DataFrame:
    """Strict form: the job fails on the first unknown state."""
    known = F.col("conn_state").isNull() | F.col("conn_state").isin(CONNECTION_STATES)
    checked = F.when(known, F.col("conn_state")).otherwise(
        F.raise_error(F.concat(F.lit("unknown conn_state: "), F.col("conn_state"))).cast("string"))
    return conns.withColumn("conn_state", checked)


# --- aggregates that need no distinct ----------------------------------------

def measure_statistics() -> list[Column]:
    """min, max, mean and population variance per measure; 0 where no value was seen."""
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "variance": F.var_pop}
    return [
        F.coalesce(fn(m), F.lit(0.0)).alias(f"{name}_{m}")
        for m in MEASURES for name, fn in stats.items()
    ]


def state_counts() -> list[Column]:
    return [F.count_if(F.col("conn_state") == s).alias(f"{s}_count") for s in CONNECTION_STATES]


def outcome_counts() -> list[Column]:
    return [
        F.count_if(f.failed_flag(F.col("conn_state"))).alias("failed_conn_count"),
        F.count_if(f.zero_resp_flag(F.col("resp_bytes"))).alias("zero_resp_bytes_count"),
    ]


def traffic_statistics(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Counts and statistics per window: fixed-size buffers, combined before the shuffle."""
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("num_conns"), *measure_statistics(), *state_counts(), *outcome_counts())


def traffic_partials(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Mergeable form of ``traffic_statistics``: counts, and per measure number, mean, squared deviations, min, max."""
    measures = [F.struct(
        F.count(m).alias("n"), F.avg(m).alias("mean"), (F.var_pop(m) * F.count(m)).alias("m2"),
        F.min(m).alias("low"), F.max(m).alias("high")).alias(m) for m in MEASURES]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("num_conns"), *state_counts(), *outcome_counts(), *measures)


def merge_traffic(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Statistics of two sets of records from their partials; a key may be on one side only."""
    counters = [c for c in a.columns if c not in key and c not in MEASURES]
    sides = [t.select(*key, F.struct(*counters, *MEASURES).alias(name)) for t, name in ((a, "_a"), (b, "_b"))]
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [(zero(F.col(f"_a.{c}")) + zero(F.col(f"_b.{c}"))).alias(c) for c in counters]
    for m in MEASURES:
        x, y = ({f: F.col(f"{s}.{m}")[f] for f in ("n", "mean", "m2", "low", "high")} for s in ("_a", "_b"))
        nx, ny = zero(x["n"]), zero(y["n"])
        n = F.nullif(nx + ny, F.lit(0))
        gap = zero(x["mean"]) - zero(y["mean"])
        mean = zero(x["mean"]) * (nx / n) + zero(y["mean"]) * (ny / n)
        m2 = zero(x["m2"]) + zero(y["m2"]) + gap * gap * (nx / n) * ny
        out += [zero(v).cast("double").alias(f"{name}_{m}") for name, v in (
            ("min", F.least(x["low"], y["low"])), ("max", F.greatest(x["high"], y["high"])), ("mean", mean),
            ("variance", m2 / n))]
    return sides[0].join(sides[1], key, "full").select(*key, *out)


# --- peers: distinct and newly seen addresses ----------------------------------

def peer_rows(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Both addresses of every connection; ``external`` tells the side."""
    sides = F.explode(F.array(
        F.struct(F.lit(True).alias("external"), F.col("ext_ip").alias("ip")),
        F.struct(F.lit(False).alias("external"), F.col("int_ip").alias("ip")),
    ))
    return rows.select(*key, sides.alias("peer")).select(*key, "peer.*")


def window_peers(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per (window, address) for both sides of the connections.

    Duplicates collapse before the shuffle, so a busy address costs at most one row per window and task.
    """
    return peer_rows(rows, key).distinct()


def mark_new_peers(peers: DataFrame, p: Params, base_day: date) -> DataFrame:
    """Add ``is_new``: first window of the day for an external address without history on the port.

    base_day mode knows only what the base day has seen; cumulative mode knows every earlier day. All days
    of an address on a port meet in one shuffle, at most one row per window each.
    """
    sightings = W.partitionBy("port", "external", "ip")
    on_day = W.partitionBy("port", "external", "ip", "day")
    if p.history_mode == "base_day":
        known = F.max(F.col("day") == F.lit(base_day)).over(sightings)
    elif p.history_mode == "cumulative":
        known = F.min("day").over(sightings) < F.col("day")
    else:
        raise ValueError(f"history_mode must be base_day or cumulative, not {p.history_mode!r}")
    return (
        peers.withColumn("known", known)
        .withColumn("first_window", F.min("timewindow").over(on_day))
        .withColumn("is_new", F.col("external") & ~F.col("known") & (F.col("timewindow") == F.col("first_window")))
        .drop("known", "first_window")
    )


def mark_new_peers_from_history(peers: DataFrame, history: DataFrame) -> DataFrame:
    """Same flag from a stored history table (port, ext_ip, ...) of earlier days: the daily job."""
    on_day = W.partitionBy("port", "external", "ip", "day")
    known = history.select("port", F.col("ext_ip").alias("ip"), F.lit(True).alias("external"),
                           F.lit(True).alias("known")).distinct()
    return (
        peers.join(known, ["port", "external", "ip"], "left")
        .withColumn("first_window", F.min("timewindow").over(on_day))
        .withColumn("is_new", F.col("external") & F.col("known").isNull()
                    & (F.col("timewindow") == F.col("first_window")))
        .drop("known", "first_window")
    )


def peer_counts(peers: DataFrame, key: list[str] = KEY) -> DataFrame:
    return peers.groupBy(*key).agg(
        F.count_if(F.col("external")).alias("external_ips"),
        F.count_if(F.col("is_new")).alias("new_external_ips"),
        F.count_if(~F.col("external")).alias("internal_ips"),
    )


def history_only(rows: DataFrame, is_history: Column) -> DataFrame:
    """Rows needed only as history are reduced to one window, so that they collapse per day and address."""
    return rows.withColumn("timewindow", F.when(is_history, F.lit(-1)).otherwise(F.col("timewindow")))


# --- the feature table -----------------------------------------------------------

def window_features(conns: DataFrame, p: Params, base_day: date) -> DataFrame:
    """Sparse feature rows for every day after ``base_day``.

    Two narrow scans instead of one multi-distinct aggregate: statistics read the measures and collapse in the
    map stage; peers read the addresses and shuffle distinct (window, address) pairs only.
    """
    start, _ = f.day_bounds(base_day, p.report_tz)
    rows = profiled_connections(conns.filter(F.col("ts") >= start), p)
    later = F.col("day") > F.lit(base_day)
    stats = traffic_statistics(rows.filter(later))
    peers = mark_new_peers(window_peers(history_only(rows, ~later)), p, base_day)
    counts = peer_counts(peers.filter(later))
    return stats.join(counts, KEY).select(*KEY, *FEATURES)


def day_window_features(conns: DataFrame, history: DataFrame, p: Params) -> DataFrame:
    """Feature rows when earlier days live in a history table (one run per day, no re-scan)."""
    rows = profiled_connections(conns, p)
    peers = mark_new_peers_from_history(window_peers(rows), history)
    return traffic_statistics(rows).join(peer_counts(peers), KEY).select(*KEY, *FEATURES)


def densify(features: DataFrame, days: DataFrame, p: Params, keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """Every (window, port) of the given days; untouched windows become zero rows."""
    grid = days.select(*keys).distinct().select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.lit(p.tw_per_day - 1))).alias("timewindow"),
    ).select(*keys, "timewindow", F.explode(F.array(*[F.lit(x) for x in p.ports])).alias("port"))
    return grid.join(features, [*keys, "timewindow", "port"], "left").fillna(0, subset=FEATURES)
