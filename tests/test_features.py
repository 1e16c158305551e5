import random
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.operators import features as ft
from harborwatch.operators import history as hs
from harborwatch.operators.ordering import ordinals, running_totals, window_ordinals
from harborwatch.schema import CONNECTION_STATES, FEATURES, MEASURES, Params
from tests.helpers import DAY, DAY0, conn_frame, day

P = Params()


def test_population_variance_and_zeros_without_values(spark):
    rows = [{"ts": DAY0 + DAY + i, "duration": float(i + 1)} for i in range(4)]
    got = ft.window_features(conn_frame(spark, rows), P, day(1)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.min_duration, r.max_duration, r.mean_duration, r.variance_duration) == (1.0, 4.0, 2.5, 1.25)
    assert (r.min_orig_bytes, r.max_orig_bytes, r.mean_orig_bytes, r.variance_orig_bytes) == (0, 0, 0, 0)


def test_ipv6_is_tested_on_the_originator_only(spark):
    rows = [{"orig_h": "fe80::1"}, {"resp_h": "fe80::2"}]
    conns = conn_frame(spark, rows)
    assert ft.drop_ipv6(conns, P).count() == 1
    assert ft.drop_ipv6(conns, Params(drop_ipv6_resp=True)).count() == 0


def test_history_modes(spark):
    at = lambda d, s=0: DAY0 + (d - 1) * DAY + s
    rows = [{"ts": at(1), "resp_h": "9.9.9.1"}, {"ts": at(2), "resp_h": "9.9.9.2"}, {"ts": at(2, 30), "resp_h": "9.9.9.2"},
            {"ts": at(3), "resp_h": "9.9.9.2"}, {"ts": at(3), "resp_h": "9.9.9.1"}]
    conns = conn_frame(spark, rows)
    base = {(r.day.day): r.new_external_ips for r in ft.window_features(conns, P, day(1)).collect()}
    cumulative = {(r.day.day): r.new_external_ips for r in
                  ft.window_features(conns, Params(history_mode="cumulative"), day(1)).collect()}
    assert base == {2: 1, 3: 1}
    assert cumulative == {2: 1, 3: 0}
    with pytest.raises(ValueError):
        ft.window_features(conns, Params(history_mode="other"), day(1))


def test_unknown_state(spark):
    conns = conn_frame(spark, [{"conn_state": "WHAT"}, {"conn_state": None}, {"conn_state": "S0"}])
    assert ft.bad_state_rows(conns).first().bad_rows == 1
    with pytest.raises(Exception, match="unknown conn_state"):
        ft.require_known_states(conns).select("conn_state").collect()
    r = ft.window_features(conns.withColumn("ts", F.col("ts") + DAY), P, day(1)).first()
    # An unset state is not a failure, an unknown one is.
    assert (r.failed_conn_count, r.S0_count, r.num_conns) == (2, 1, 3)


def reference_features(rows, p, base_day):
    """Window features record by record."""
    out = defaultdict(lambda: {"ext": set(), "int": set(), "new": 0, "n": 0, "state": defaultdict(int), "failed": 0,
                               "zero": 0, **{m: [] for m in MEASURES}})
    known = defaultdict(set)
    today = defaultdict(set)
    for r in sorted(rows, key=lambda r: (r["ts"], r["uid"])):
        if r["resp_p"] not in p.ports or ":" in r["orig_h"]:
            continue
        second = int(r["ts"] - DAY0)
        d, tw = second // 86400 + 1, second % 86400 // p.tw_seconds
        inside, outside = (r["orig_h"], r["resp_h"]) if r["orig_h"].startswith("147.32") else (r["resp_h"], r["orig_h"])
        if d == base_day:
            known[r["resp_p"]].add(outside)
            continue
        w = out[(d, tw, r["resp_p"])]
        seen = today[(d, r["resp_p"])]
        if outside not in known[r["resp_p"]] and outside not in seen:
            seen.add(outside)
            w["new"] += 1
        w["ext"].add(outside)
        w["int"].add(inside)
        w["n"] += 1
        for m in MEASURES:
            if r[m] is not None:
                w[m].append(r[m])
        w["state"][r["conn_state"]] += 1
        w["failed"] += r["conn_state"] not in (None, "S1", "SF")
        w["zero"] += r["resp_bytes"] == 0
    return out


def random_rows(n, seed, days=3, hot=0.4):
    """Random records; one external address and one minute take a large share."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        busy = rng.random() < hot
        inside = f"147.32.{rng.randrange(3)}.{rng.randrange(4)}"
        outside = "203.0.0.7" if busy else f"203.0.{rng.randrange(3)}.{rng.randrange(40)}"
        flip = rng.random() < 0.3
        second = 600 if busy else rng.randrange(0, 7200)
        value = lambda top: None if rng.random() < 0.2 else float(rng.randrange(top))
        rows.append({"uid": f"u{i:05d}", "ts": DAY0 + rng.randrange(days) * DAY + second + rng.random(),
                     "orig_h": "fe80::3" if rng.random() < 0.03 else (outside if flip else inside),
                     "resp_h": inside if flip else outside, "resp_p": rng.choice([22, 80, 80, 443, 9000]),
                     "duration": value(50), "orig_bytes": value(2000), "resp_bytes": value(3), "orig_pkts": value(9),
                     "resp_pkts": value(9), "conn_state": rng.choice([None, *CONNECTION_STATES])})
    return rows


@pytest.mark.parametrize("tw", [60, 900])
def test_window_features_match_a_record_loop(spark, tw):
    p = Params(tw_seconds=tw)
    rows = random_rows(1500, seed=tw)
    want = reference_features(rows, p, base_day=1)
    got = {(r.day.day, r.timewindow, r.port): r for r in ft.window_features(conn_frame(spark, rows), p, day(1)).collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        r = got[key]
        assert (r.external_ips, r.internal_ips, r.new_external_ips, r.num_conns) == (len(w["ext"]), len(w["int"]), w["new"], w["n"])
        assert (r.failed_conn_count, r.zero_resp_bytes_count) == (w["failed"], w["zero"])
        assert [r[f"{s}_count"] for s in CONNECTION_STATES] == [w["state"][s] for s in CONNECTION_STATES]
        for m in MEASURES:
            v = w[m] or [0.0]
            assert [r[f"{s}_{m}"] for s in ("min", "max", "mean", "variance")] == pytest.approx(
                [min(v), max(v), np.mean(v), np.var(v)], abs=1e-9)


def test_daily_job_with_stored_history_gives_the_same_rows(spark):
    conns = conn_frame(spark, random_rows(800, seed=5))
    whole = ft.window_features(conns, P, day(1))
    rows = ft.profiled_connections(conns, P)
    known = hs.history_by_day_port(rows.filter(F.col("day") == F.lit(day(1))))
    daily = ft.day_window_features(ft.day_filter(conns, day(2), P), known, P)
    want = sorted(map(tuple, whole.filter(F.col("day") == F.lit(day(2))).collect()))
    got = sorted(map(tuple, daily.collect()))
    assert [tuple(np.round(x, 9) if isinstance(x, float) else x for x in r) for r in got] == [
        tuple(np.round(x, 9) if isinstance(x, float) else x for x in r) for r in want]


def test_new_ip_total_is_the_set_difference(spark):
    conns = conn_frame(spark, random_rows(1000, seed=8))
    rows = ft.profiled_connections(conns, P)
    base = hs.history_by_day_port(rows.filter(F.col("day") == F.lit(day(1))))
    new = hs.new_external(rows.filter(F.col("day") > F.lit(day(1))), base).count()
    total = ft.window_features(conns, P, day(1)).agg(F.sum("new_external_ips").alias("n")).first().n
    assert new == total


def test_dense_grid(spark):
    conns = conn_frame(spark, [{"ts": DAY0 + DAY + 120}])
    dense = ft.densify(ft.window_features(conns, P, day(1)), spark.createDataFrame([(day(2),)], "day date"), P)
    assert dense.count() == 1440 * 5
    assert dense.filter("num_conns > 0").count() == 1
    assert dense.select(*FEATURES).dropna().count() == 1440 * 5


def test_statistics_combine_before_the_shuffle_and_scan_is_pruned(spark, tmp_path):
    conn_frame(spark, random_rows(50, seed=1)).write.parquet(str(tmp_path / "c"))
    plan = ft.window_features(spark.read.parquet(str(tmp_path / "c")), P, day(1))._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan"):]
    assert "partial_var_pop(duration" in physical
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert "GreaterThanOrEqual(ts" in physical
    # The peer scan reads addresses only.
    assert "ReadSchema: struct<ts:double,orig_h:string,resp_h:string,resp_p:int>" in physical


# --- ordinals over hot groups ------------------------------------------------------

def test_ordinals_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", rng.randrange(200), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, u int")
    got = ordinals(df, ["k", "u"], {"n": ["g"], "all": []}).collect()
    want, count = {}, defaultdict(int)
    for place, (g, k, u) in enumerate(sorted(data, key=lambda r: (r[1], r[2])), 1):
        count[g] += 1
        want[u] = (count[g], place)
    assert {r.u: (r.n, r["all"]) for r in got} == want


def test_running_totals_of_values(spark):
    data = [(i % 2, i, (i * 7) % 5) for i in range(500)]
    df = spark.createDataFrame(data, "g int, k int, v int")
    got = {r.k: r.s for r in running_totals(df, ["k"], {"s": (["g"], F.col("v"))}).collect()}
    for g in (0, 1):
        total = 0
        for _, k, v in [d for d in data if d[0] == g]:
            total += v
            assert got[k] == total


def test_window_ordinals_cross_days(spark):
    data = [(22, d, t) for d in (1, 2, 3) for t in range(d)] + [(80, 1, 5)]
    df = spark.createDataFrame(data, "port int, day int, timewindow int")
    got = {(r.port, r.day, r.timewindow): r.n for r in
           window_ordinals(df, ["port"], ["timewindow"], "day", "n").collect()}
    want = {k: i for i, k in enumerate(sorted(d for d in data if d[0] == 22), 1)} | {(80, 1, 5): 1}
    assert got == want


# --- subnets -------------------------------------------------------------------------

def test_fourth_largest_network(spark):
    hosts = [(day(1), f"10.{i}.0.", f"10.{i}.0.{j}") for i in range(5) for j in range(10 - i)]
    sizes = hs.subnet_sizes(spark.createDataFrame(hosts, "day date, subnet24 string, int_ip string"))
    assert hs.find_network(sizes).first().network == "10.3.0.0/16"


def test_choosing_more_subnets_than_there_are_fails(spark):
    hosts = [(day(1), "147.32.1.", "147.32.1.5"), (day(1), "147.32.2.", "147.32.2.5"), (day(1), "8.8.8.", "8.8.8.8")]
    sizes = hs.subnet_sizes(spark.createDataFrame(hosts, "day date, subnet24 string, int_ip string"))
    assert hs.choose_subnets(sizes, P, k=2).count() == 2
    with pytest.raises(Exception, match="too few eligible subnets"):
        hs.choose_subnets(sizes, P, k=3).collect()
    second = sizes.unionByName(hs.subnet_sizes(spark.createDataFrame(
        [(day(2), "8.8.8.", "8.8.8.8")], "day date, subnet24 string, int_ip string")))
    with pytest.raises(Exception, match="too few eligible subnets"):
        hs.choose_subnets(second, P, min_hosts=1).collect()


def test_local_zone_moves_day_and_window(spark):
    p = Params(report_tz="US/Eastern")
    r = ft.with_time_window(conn_frame(spark, [{"ts": DAY0 + 3600.5}]), p).first()
    assert (r.day, r.timewindow) == (date(2023, 12, 31), 20 * 60)
