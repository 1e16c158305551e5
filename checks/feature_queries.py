"""Window features, history, joins and the attack overlay (J*, A1-A16, W1-W3, O*)."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from checks import fixtures as x
from checks import sql as q
from checks.ingest_queries import mapping, oriented, placed, prepared, training_windows, window_features
from checks.registry import query, rounded
from harborwatch.operators import attack, features, history
from harborwatch.plans import daily
from harborwatch.plans import overlay as overlay_plan
from harborwatch.schema import FEATURES, Params, THINNING
from harborwatch.session import work_path
from harborwatch.sources import tables

P = x.PARAMS_60
KEY = "day, timewindow, port"
FACTORS = THINNING


# --- features of background days ---------------------------------------------------

for _tw in (60, 3600):
    def _window_features(spark, sf_dir, p=Params(tw_seconds=_tw)):
        return rounded(window_features(spark, sf_dir, p))

    query(f"window_features_{_tw}s", q.with_(q.features(_tw), q.rounded_features(KEY, "features")))(_window_features)


@query("window_features_cumulative", q.with_(q.features(3600, "cumulative"), q.rounded_features(KEY, "features")))
def window_features_cumulative(spark, sf_dir):
    return rounded(window_features(spark, sf_dir, Params(tw_seconds=3600, history_mode="cumulative")))


@query("recorded_features_cumulative", q.with_(q.features(3600, "cumulative"), q.rounded_features(KEY, "features")))
def recorded_features_cumulative(spark, sf_dir):
    """The same features from a stored table of first sightings: one run for the first weeks, then day by day."""
    p = Params(tw_seconds=3600, history_mode="cumulative")
    conns, name = x.conn(spark, sf_dir), f"first_seen_{uuid.uuid4().hex}"
    tables.first_seen_table(spark, name, work_path(spark, "first-seen"), buckets=8)
    days = [x.BASE_DAY + timedelta(days=i) for i in range((x.TEST_DAY - x.BASE_DAY).days + 1)]
    for run in (days[:-3], *([d] for d in days[-3:])):
        daily.record_first_seen(conns, run, name, p)
    return rounded(daily.recorded_features(conns, days[1:], name, p))


@query("day_window_features", q.with_(q.features(3600), q.rounded_features(KEY, "features")))
def day_window_features(spark, sf_dir):
    """Same rows from a stored base-day history."""
    conns = x.conn(spark, sf_dir)
    rows = features.profiled_connections(conns, x.PARAMS_3600)
    known = history.history_by_day_port(rows.filter(F.col("day") == F.lit(x.BASE_DAY)))
    later = conns.filter(F.col("ts") >= x.EPOCH + 86400)
    return rounded(features.day_window_features(later, known, x.PARAMS_3600))


def _one(spark, sf_dir, *columns):
    return window_features(spark, sf_dir, x.PARAMS_3600).select("day", "timewindow", "port", *columns)


for _name, _columns in {
    "external_ips": ["external_ips"], "internal_ips": ["internal_ips"], "num_conns": ["num_conns"],
    "new_external_ips": ["new_external_ips"],
    "measure_stats": [c for c in FEATURES if c in q.DOUBLES],
    "state_counts": [c for c in FEATURES if c.endswith("_count") and c[:1].isupper()],
    "outcome_counts": ["failed_conn_count", "zero_resp_bytes_count"],
}.items():
    def _column_query(spark, sf_dir, columns=tuple(_columns)):
        return rounded(_one(spark, sf_dir, *columns))

    _select = ", ".join(f"round({c}, 6) AS {c}" if c in q.DOUBLES else c for c in _columns)
    query(_name, q.with_(q.features(3600), f"SELECT {KEY}, {_select} FROM features"))(_column_query)


@query("bad_state_rows", q.with_(q.conn(), """
    SELECT count(*) AS bad_rows FROM conn WHERE conn_state IN ('SH', 'SHR')"""))
def bad_state_rows(spark, sf_dir):
    """Two states are renamed to names outside the list."""
    renamed = F.when(F.col("conn_state").isin("SH", "SHR"), F.concat(F.col("conn_state"), F.lit("?"))).otherwise(F.col("conn_state"))
    return features.bad_state_rows(x.conn(spark, sf_dir).withColumn("conn_state", renamed))


@query("densify", q.with_([*q.features(3600), ("ports", "SELECT * FROM (VALUES (22), (23), (80), (443), (445)) t(port)")], f"""
    SELECT d.day, cast(g.w AS int) AS timewindow, p.port,
           {', '.join(f'round(coalesce(f.{c}, 0), 6) AS {c}' if c in q.DOUBLES else f'coalesce(f.{c}, 0) AS {c}' for c in FEATURES)}
    FROM (SELECT DISTINCT day FROM features) d CROSS JOIN range(24) g(w) CROSS JOIN ports p
    LEFT JOIN features f ON f.day = d.day AND f.timewindow = g.w AND f.port = p.port"""))
def densify(spark, sf_dir):
    table = window_features(spark, sf_dir)
    return rounded(features.densify(table, table, x.PARAMS_3600))


# --- history and subnets -----------------------------------------------------------

@query("history_by_day_port", q.with_(q.oriented(60), "SELECT DISTINCT day, port, ext_ip FROM oriented"))
def history_by_day_port(spark, sf_dir):
    return history.history_by_day_port(oriented(spark, sf_dir))


@query("new_external", q.with_(q.oriented(60), """
    SELECT DISTINCT day, port, ext_ip FROM oriented o WHERE day > DATE '2024-01-01' AND NOT EXISTS (
      SELECT 1 FROM oriented h WHERE h.day = DATE '2024-01-01' AND h.port = o.port AND h.ext_ip = o.ext_ip)"""))
def new_external(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    base = rows.filter(F.col("day") == F.lit(x.BASE_DAY))
    return history.new_external(rows.filter(F.col("day") > F.lit(x.BASE_DAY)), history.history_by_day_port(base))


@query("first_seen", q.with_(q.oriented(60), """
    SELECT day, port, ext_ip, ts, uid, timewindow FROM (
      SELECT *, row_number() OVER (PARTITION BY day, port, ext_ip ORDER BY ts, uid) AS rn FROM oriented) o WHERE rn = 1"""))
def first_seen(spark, sf_dir):
    return history.first_seen(oriented(spark, sf_dir))


@query("history_list", q.with_(q.oriented(60), """
    SELECT port, row_number() OVER (PARTITION BY port ORDER BY day, ext_ip) - 1 AS position, day, ext_ip
    FROM (SELECT DISTINCT day, port, ext_ip FROM oriented) h"""))
def history_list(spark, sf_dir):
    return history.history_list(history.history_by_day_port(oriented(spark, sf_dir)))


_SUBNETS = [*q.oriented(60), ("hosts", r"""
    SELECT DISTINCT day, regexp_extract(int_ip, '^(\d+\.\d+\.\d+\.)', 1) AS subnet24, int_ip FROM oriented"""),
    ("sizes", "SELECT day, subnet24, count(*) AS n_ips FROM hosts GROUP BY day, subnet24")]


def _sizes(spark, sf_dir):
    return history.subnet_sizes(history.subnet_hosts(oriented(spark, sf_dir)))


@query("subnet_hosts", q.with_(_SUBNETS, "SELECT day, subnet24, n_ips FROM sizes"))
def subnet_hosts(spark, sf_dir):
    return _sizes(spark, sf_dir)


@query("network_rollup", q.with_(_SUBNETS, r"""
    SELECT day, subnet16, n_subnets, n_ips, row_number() OVER (PARTITION BY day ORDER BY n_ips DESC, subnet16) AS size_rank FROM (
      SELECT day, regexp_extract(subnet24, '^(\d+\.\d+\.)', 1) AS subnet16, count(*) AS n_subnets,
             cast(sum(n_ips) AS bigint) AS n_ips FROM sizes GROUP BY 1, 2) r"""))
def network_rollup(spark, sf_dir):
    return history.network_rollup(_sizes(spark, sf_dir)).withColumn("size_rank", F.col("size_rank").cast("long"))


@query("find_network", q.with_(q.oriented(60), r"""
    SELECT day, subnet16 || '0.0/16' AS network FROM (
      SELECT day, subnet16, row_number() OVER (PARTITION BY day ORDER BY n_ips DESC, subnet16) AS r FROM (
        SELECT day, regexp_extract(ip, '^(\d+\.\d+\.)', 1) AS subnet16, count(DISTINCT ip) AS n_ips
        FROM (SELECT day, int_ip AS ip FROM oriented UNION ALL SELECT day, ext_ip AS ip FROM oriented) a GROUP BY 1, 2) g) r
    WHERE r = 2"""))
def find_network(spark, sf_dir):
    """Second largest network over the addresses of both sides (the tables span two)."""
    rows = oriented(spark, sf_dir)
    both = rows.select("day", "int_ip").unionByName(rows.select("day", F.col("ext_ip").alias("int_ip")))
    return history.find_network(history.subnet_sizes(history.subnet_hosts(both)), rank=2)


@query("eligible_subnets", q.with_(_SUBNETS, """
    SELECT day, subnet24, n_ips, choice FROM (
      SELECT *, row_number() OVER (PARTITION BY day ORDER BY md5('7|' || subnet24), subnet24) AS choice
      FROM sizes WHERE subnet24 LIKE '147.32.%' AND n_ips >= 2) s WHERE choice <= 2"""))
def eligible_subnets(spark, sf_dir):
    chosen = history.choose_subnets(_sizes(spark, sf_dir), x.PARAMS_OVERLAY, k=2)
    return chosen.withColumn("choice", F.col("choice").cast("long"))


# --- attack traces -----------------------------------------------------------------

@query("drop_internal_only_sources", q.with_(q.attack(), "SELECT uid, orig_h, resp_h FROM outward"))
def drop_internal_only_sources(spark, sf_dir):
    kept = attack.attack_row_filter(x.attack_raw(spark, sf_dir), x.PARAMS_OVERLAY)
    return attack.drop_internal_only_sources(kept, x.PARAMS_OVERLAY).select("uid", "orig_h", "resp_h")


@query("remap_internal_dst", q.with_(q.attack(), "SELECT uid, orig_h, resp_h FROM attack"))
def remap_internal_dst(spark, sf_dir):
    return prepared(spark, sf_dir).select("uid", "orig_h", "resp_h")


_COUNTED = [*q.attack(), ("counted", """
    SELECT *, row_number() OVER (PARTITION BY orig_h ORDER BY ts, uid) AS nth, row_number() OVER (ORDER BY ts, uid) AS ordinal
    FROM attack""")]
_FACTORS = ", ".join(f"({n})" for n in FACTORS)


@query("thin_variant", q.with_(_COUNTED, f"""
    SELECT cast(n AS varchar) || 'wannacry' AS variant, uid, orig_h, resp_h, ts
    FROM counted CROSS JOIN (VALUES {_FACTORS}) f(n) WHERE nth % n = 0"""))
def thin_variant(spark, sf_dir):
    thinned = attack.thin_variant(prepared(spark, sf_dir), FACTORS)
    return thinned.select("variant", "uid", "orig_h", "resp_h", "ts")


_LISTED = [*q.oriented(60), ("listed", """
    SELECT port, ext_ip, row_number() OVER (PARTITION BY port ORDER BY day, ext_ip) - 1 AS position,
           count(*) OVER (PARTITION BY port) AS length FROM (SELECT DISTINCT day, port, ext_ip FROM oriented) h""")]


@query("cycle_history_ip", q.with_([*_COUNTED, *_LISTED], """
    SELECT c.uid, l.port, l.ext_ip AS cycled_ip FROM counted c JOIN listed l ON c.ordinal % l.length = l.position"""))
def cycle_history_ip(spark, sf_dir):
    from harborwatch.operators.ordering import ordinals

    trace = ordinals(prepared(spark, sf_dir), ["ts", "uid"], {"ordinal": ["variant"]})
    on_ports = attack.overlay_all_ports(trace, P)
    known = history.history_by_day_port(oriented(spark, sf_dir))
    return attack.cycle_history_ip(on_ports, known, "ordinal").select("uid", "port", "cycled_ip")


@query("history_variant", q.with_([*_COUNTED, *_LISTED], f"""
    SELECT 'port_' || l.port || '_history' || n || '_wannacry' AS variant, c.uid,
           CASE WHEN c.nth % n = 0 THEN c.resp_h ELSE l.ext_ip END AS resp_h
    FROM counted c JOIN listed l ON c.ordinal % l.length = l.position CROSS JOIN (VALUES {_FACTORS}) f(n)"""))
def history_variant(spark, sf_dir):
    known = history.history_by_day_port(oriented(spark, sf_dir))
    redirected = overlay_plan.redirected_variants(prepared(spark, sf_dir), known, P, FACTORS)
    return redirected.select("variant", "uid", "resp_h")


@query("map_attackers", q.with_(q.mapping(60), "SELECT day, attacker_ip, int_ip FROM mapping"))
def map_attackers(spark, sf_dir):
    return mapping(spark, sf_dir)


@query("overlay_all_ports", q.with_(q.placed(60), f"""
    SELECT port, timewindow, count(*) AS n, count(DISTINCT ext_ip) AS ips FROM placed
    CROSS JOIN (VALUES (22), (23), (80), (443), (445)) p(port) GROUP BY port, timewindow"""))
def overlay_all_ports(spark, sf_dir):
    rows = attack.overlay_all_ports(placed(spark, sf_dir), P)
    return rows.groupBy("port", "timewindow").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ext_ip").alias("ips"))


@query("past_midnight_rows", q.with_(q.attack_raw(), f"""
    SELECT 'wannacry' AS variant, count(*) AS dropped_rows
    FROM (SELECT (ts - (SELECT min(ts) FROM attack_raw)) * {x.SPEEDUP} AS ts FROM attack_raw) a
    WHERE cast(floor(ts) AS bigint) % 86400 >= 43200"""))
def past_midnight_rows(spark, sf_dir):
    """The trace at its original pace: 30 days, half of them after midnight of the merge day."""
    slow = attack.relative_time(x.attack_raw(spark, sf_dir)).withColumn("ts", F.col("ts") * x.SPEEDUP)
    return attack.past_midnight_rows(attack.attack_window(slow, P), P)


_ATTACK_WINDOWS = [*q.placed(60), ("attack_windows", f"""
    SELECT timewindow, count(DISTINCT ext_ip) AS external_ips, count(DISTINCT int_ip) AS internal_ips, {q.traffic_aggregates()}
    FROM placed GROUP BY timewindow""")]


@query("attack_window_features", q.with_(_ATTACK_WINDOWS, "SELECT timewindow, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in q.DOUBLES else c for c in FEATURES if c != "new_external_ips") + " FROM attack_windows"))
def attack_window_features(spark, sf_dir):
    return rounded(attack.attack_window_features(placed(spark, sf_dir)).drop("variant"))


@query("propagation_rate", q.with_(_ATTACK_WINDOWS, """
    SELECT 'wannacry' AS variant, round(avg(external_ips), 6) AS ips_per_window, count(*) AS active_windows FROM attack_windows"""))
def propagation_rate(spark, sf_dir):
    return rounded(attack.propagation_rate(attack.attack_window_features(placed(spark, sf_dir))))


def test_day(spark, sf_dir, p=x.PARAMS_OVERLAY):
    return overlay_plan.labelled_day(
        x.conn(spark, sf_dir), prepared(spark, sf_dir), ["wannacry"], x.TEST_DAY, p, x.BASE_DAY).features


@query("merge_overlay", q.with_(q.overlay(60), q.rounded_features("variant, day, timewindow, port", "test", label=True)))
def merge_overlay(spark, sf_dir):
    return rounded(test_day(spark, sf_dir))


def _thinned(n: int) -> str:
    """The overlay with every n-th record of each source, its time counted from the first record kept."""
    ctes = []
    for name, body in q.overlay(60):
        if name == "attack":
            ctes += [("whole", body), ("attack", f"""
                SELECT * EXCLUDE (ts, nth), ts - min(ts) OVER () AS ts FROM (
                  SELECT *, row_number() OVER (PARTITION BY orig_h ORDER BY ts, uid) AS nth FROM whole) w WHERE nth % {n} = 0""")]
        else:
            ctes.append((name, body.replace("'wannacry' AS variant", f"'{n}wannacry' AS variant")))
    return q.with_(ctes, q.rounded_features("variant, day, timewindow, port", "test", label=True))


@query("merge_overlay_variants", " UNION ALL ".join(f"SELECT * FROM ({one}) v" for one in (
    q.with_(q.overlay(60), q.rounded_features("variant, day, timewindow, port", "test", label=True)),
    *map(_thinned, THINNING))))
def merge_overlay_variants(spark, sf_dir):
    """The prepared trace and all its thinned versions on one background day."""
    p = x.PARAMS_OVERLAY
    trace = overlay_plan.prepared_variants(x.attack_raw(spark, sf_dir), p)
    names = ["wannacry", *[f"{n}wannacry" for n in THINNING]]
    return rounded(overlay_plan.labelled_day(x.conn(spark, sf_dir), trace, names, x.TEST_DAY, p, x.BASE_DAY).features)


def _redirected(port: int, n: int) -> str:
    """The overlay of the trace that keeps every n-th record and sends the others to addresses the port knows."""
    name = f"port_{port}_history{n}_wannacry"
    ctes = [*_LISTED]
    for cte, body in q.overlay(60):
        if cte == "attack":
            ctes += [("whole", body), ("attack", f"""
                SELECT c.* EXCLUDE (nth, ordinal, resp_h), CASE WHEN nth % {n} = 0 OR l.ext_ip IS NULL THEN resp_h ELSE l.ext_ip END AS resp_h
                FROM (SELECT *, row_number() OVER (PARTITION BY orig_h ORDER BY ts, uid) AS nth,
                             row_number() OVER (ORDER BY ts, uid) AS ordinal FROM whole) c
                LEFT JOIN listed l ON l.port = {port} AND c.ordinal % l.length = l.position""")]
        else:
            ctes.append((cte, body.replace("'wannacry' AS variant", f"'{name}' AS variant")))
    return q.with_(ctes, q.rounded_features("variant, day, timewindow, port", "test", label=True))


@query("merge_overlay_redirected", " UNION ALL ".join(
    f"SELECT * FROM ({_redirected(port, n)}) v" for port in P.ports for n in FACTORS))
def merge_overlay_redirected(spark, sf_dir):
    """All redirected versions of the trace, per port and factor, on one background day."""
    p = x.PARAMS_OVERLAY
    known = history.history_by_day_port(oriented(spark, sf_dir))
    trace = overlay_plan.redirected_variants(prepared(spark, sf_dir), known, p, FACTORS, packed=True)
    packed = attack.redirections(FACTORS, p)
    names = [f"port_{port}_history{n}_wannacry" for port in p.ports for n in FACTORS]
    return rounded(overlay_plan.labelled_day(
        x.conn(spark, sf_dir), trace, names, x.TEST_DAY, p, x.BASE_DAY, packed=packed).features)


@query("label_windows", q.with_(q.overlay(60), "SELECT timewindow, port, label FROM test"))
def label_windows(spark, sf_dir):
    return test_day(spark, sf_dir).select("timewindow", "port", "label")


@query("malicious_count", q.with_(q.placed(60), "SELECT timewindow, count(*) AS malicious, count(*) > 0 AS label FROM placed GROUP BY timewindow"))
def malicious_count(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("timewindow").agg(
        F.count(F.lit(1)).alias("malicious"), (F.count(F.lit(1)) > 0).alias("label"))


# --- sorts and unions ----------------------------------------------------------------

@query("sort_by_ts", q.with_(q.attack(), "SELECT uid, row_number() OVER (ORDER BY ts, uid) AS place FROM attack"))
def sort_by_ts(spark, sf_dir):
    from harborwatch.operators.ordering import ordinals

    return ordinals(prepared(spark, sf_dir), ["ts", "uid"], {"place": ["variant"]}).select("uid", "place")


@query("sort_subnets_desc", q.with_(_SUBNETS, """
    SELECT day, subnet24, n_ips, row_number() OVER (PARTITION BY day ORDER BY n_ips DESC, subnet24) AS place FROM sizes"""))
def sort_subnets_desc(spark, sf_dir):
    from harborwatch.operators.ordering import ordinals

    keyed = _sizes(spark, sf_dir).withColumn("neg", -F.col("n_ips"))
    return ordinals(keyed, ["neg", "subnet24", "day"], {"place": ["day"]}).drop("neg")


@query("concat_days", q.with_(q.train(3600, q.PORTS), "SELECT day, port, count(*) AS windows FROM train GROUP BY day, port"))
def concat_days(spark, sf_dir):
    """Two halves of the training days stacked again."""
    table = training_windows(spark, sf_dir, ports=P.ports)
    split = F.lit("2024-01-15").cast("date")
    both = table.filter(F.col("day") < split).unionByName(table.filter(F.col("day") >= split))
    return both.groupBy("day", "port").agg(F.count(F.lit(1)).alias("windows"))


@query("set_union", q.with_(q.placed(60), """
    SELECT timewindow, count(DISTINCT ip) AS ips FROM (
      SELECT timewindow, ext_ip AS ip FROM placed UNION ALL SELECT timewindow, ext_ip FROM oriented WHERE day = DATE '2024-01-30') u
    GROUP BY timewindow"""))
def set_union(spark, sf_dir):
    today = oriented(spark, sf_dir).filter(F.col("day") == F.lit(x.TEST_DAY)).select("timewindow", "ext_ip")
    union = placed(spark, sf_dir).select("timewindow", "ext_ip").unionByName(today).distinct()
    return union.groupBy("timewindow").agg(F.count(F.lit(1)).alias("ips"))
