from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.operators import attack as at
from harborwatch.operators import features as ft
from harborwatch.operators import history as hs
from harborwatch.plans import overlay
from harborwatch.schema import CONNECTION_STATES, FEATURES, MEASURES, Params
from harborwatch.sources import conn_log
from tests.helpers import DAY0, conn_frame, day
from tests.test_features import random_rows

P = Params(attackers=("192.168.1.114", "192.168.1.50"))


def trace_frame(spark, rows):
    return conn_frame(spark, [{"resp_p": 445, "orig_h": "192.168.1.114", **r} for r in rows]).withColumn("variant", F.lit("w"))


def test_only_attack_traffic_of_outward_sources_is_kept(spark):
    rows = [{"resp_h": "1.2.3.4"}, {"resp_h": "192.168.1.9"}, {"resp_h": "192.168.1.9"}, {"resp_p": 139},
            {"orig_h": "192.168.1.50", "resp_h": "192.168.1.7"}, {"orig_h": "192.168.1.77", "resp_h": "1.1.1.1"}]
    got = [(r.uid, r.resp_h) for r in at.prepare_attack(trace_frame(spark, rows), P).orderBy("uid").collect()]
    assert [u for u, _ in got] == ["u0000", "u0001", "u0002"]
    assert got[0][1] == "1.2.3.4"
    # The same (source, destination) pair keeps one public address.
    assert got[1][1] == got[2][1] and not got[1][1].startswith("192.168.")


def test_records_are_not_gathered_by_their_few_sources(spark, tmp_path):
    trace_frame(spark, [{"ts": float(i), "resp_h": f"198.51.0.{i % 9}"} for i in range(50)]).repartition(3).write.parquet(str(tmp_path / "t"))
    prepared = at.drop_internal_only_sources(at.attack_row_filter(spark.read.parquet(str(tmp_path / "t")), P), P, few=True)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a long trace
    try:
        whole = at.prepare_attack(spark.read.parquet(str(tmp_path / "t")), P)
        assert whole.count() == prepared.count() == 50
        plan = whole._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_relative_time_is_per_variant(spark):
    t = trace_frame(spark, [{"ts": 100.0}, {"ts": 103.5}])
    both = t.unionByName(t.withColumn("ts", F.col("ts") + 7).withColumn("variant", F.lit("x")))
    got = sorted((r.variant, r.ts) for r in at.relative_time(both).collect())
    assert got == [("w", 0.0), ("w", 3.5), ("x", 0.0), ("x", 3.5)]


def test_thinning_keeps_every_nth_record_of_a_source(spark):
    t = trace_frame(spark, [{"ts": float(i)} for i in range(17)])
    got = at.thin_variant(t, [2, 4, 8, 16]).groupBy("variant").count().collect()
    assert {r.variant: r["count"] for r in got} == {"2w": 8, "4w": 4, "8w": 2, "16w": 1}


def test_thinning_of_many_sources(spark):
    rows = [{"ts": float(i), "orig_h": "192.168.1.114" if i % 3 else f"192.168.2.{i % 7}"} for i in range(400)]
    got = {(r.variant, r.orig_h): r["count"] for r in
           at.thin_variant(trace_frame(spark, rows), [8]).groupBy("variant", "orig_h").count().collect()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["orig_h"]] += 1
    assert got == {("8w", s): n // 8 for s, n in sizes.items() if n >= 8}


def test_redirected_records_cycle_through_the_history(spark):
    known = spark.createDataFrame([(day(1), 80, "b"), (day(1), 80, "a"), (day(2), 80, "a"), (day(1), 22, "z")],
                                  "day date, port int, ext_ip string")
    t = trace_frame(spark, [{"ts": float(i), "resp_h": f"d{i}"} for i in range(5)])
    p = Params(ports=(22, 80, 443))
    rows = at.history_variant(t, known, [2], p).collect()
    by_port = defaultdict(dict)
    for r in rows:
        by_port[r.variant][r.ts] = r.resp_h
    listed = ["a", "b", "a"]
    assert by_port["port_80_history2_w"] == {
        float(i): (f"d{i}" if (i + 1) % 2 == 0 else listed[(i + 1) % 3]) for i in range(5)}
    assert by_port["port_22_history2_w"] == {float(i): (f"d{i}" if (i + 1) % 2 == 0 else "z") for i in range(5)}
    # No history on the port: nothing to redirect to.
    assert by_port["port_443_history2_w"] == {float(i): f"d{i}" for i in range(5)}


def test_attack_past_midnight_is_dropped_and_counted(spark):
    t = trace_frame(spark, [{"ts": 50.0}, {"ts": 50.0 + 12 * 3600 - 1}, {"ts": 50.0 + 13 * 3600}])
    windows = at.attack_window(t, P)
    assert sorted(r.timewindow for r in windows.collect()) == [720, 1439, 1500]
    assert at.past_midnight_rows(windows, P).first().dropped_rows == 1


def test_prepared_trace_survives_its_text_form(spark, tmp_path):
    t = trace_frame(spark, [{"ts": 1.5, "duration": 0.5}, {"ts": 2.0, "orig_bytes": 3.0}])
    conn_log.sink_prepared(t, str(tmp_path / "p"))
    back = conn_log.scan_prepared(spark, str(tmp_path / "p"))
    cols = ["uid", "ts", "duration", "orig_bytes", "resp_p", "variant"]
    assert sorted(map(tuple, back.select(*cols).collect()), key=str) == sorted(map(tuple, t.select(*cols).collect()), key=str)
    header = spark.read.text(str(tmp_path / "p" / "variant=w")).first().value
    assert header.split("\t")[:3] == ["ts", "uid", "id.orig_h"] and len(header.split("\t")) == 21


class Window:
    """Everything one window has seen, kept record by record."""

    def __init__(self):
        self.records, self.ext, self.int, self.new = [], set(), set(), 0

    def add(self, r, inside, outside, is_new):
        self.records.append(r)
        self.ext.add(outside)
        self.int.add(inside)
        self.new += is_new

    def row(self):
        states = [r["conn_state"] for r in self.records]
        out = {"external_ips": len(self.ext), "internal_ips": len(self.int), "new_external_ips": self.new,
               "num_conns": len(self.records), "failed_conn_count": sum(s not in (None, "S1", "SF") for s in states),
               "zero_resp_bytes_count": sum(r["resp_bytes"] == 0 for r in self.records)}
        out |= {f"{s}_count": states.count(s) for s in CONNECTION_STATES}
        for m in MEASURES:
            v = np.array([r[m] for r in self.records if r[m] is not None] or [0.0])
            out |= {f"min_{m}": v.min(), f"max_{m}": v.max(), f"mean_{m}": v.mean(), f"variance_{m}": v.var()}
        return out


@pytest.mark.parametrize("mode", ["base_day", "cumulative"])
def test_overlay_matches_a_record_loop(spark, mode):
    p = Params(tw_seconds=600, history_mode=mode, attackers=("192.168.1.114",))
    bg = random_rows(600, seed=21)
    bg += [{**r, "uid": "n" + r["uid"], "ts": DAY0 + 2 * 86400 + 43200 + i} for i, r in enumerate(bg[:60])]
    attack = []
    for i, r in enumerate(random_rows(200, seed=22, days=1)):
        attack.append({**r, "uid": f"a{i:04d}", "ts": i * 9.0, "orig_h": "192.168.1.114",
                       "resp_h": f"198.51.0.{i % 37}" if i % 4 else f"203.0.{i % 3}.{i % 40}", "resp_p": 445})
    conns = conn_frame(spark, bg)
    trace = trace_frame(spark, attack)
    mapping = spark.createDataFrame([(day(3), "192.168.1.114", "147.32.9.9"), (day(2), "192.168.1.114", "x")],
                                    "day date, attacker_ip string, int_ip string")
    got = at.merge_overlay(conns, trace, mapping, ["w"], day(3), p, day(1)).collect()
    stored = hs.history_by_day_port(ft.profiled_connections(conns, p))
    today = ft.day_filter(conns, day(3), p)
    again = at.merge_overlay(today, trace, mapping, ["w"], day(3), p, day(1), known=stored).collect()
    counts = lambda rows: sorted((r.timewindow, r.port, r.external_ips, r.new_external_ips, r.num_conns) for r in rows)
    assert counts(again) == counts(got)
    assert len(got) == p.tw_per_day * len(p.ports)

    state = defaultdict(Window)
    seen = defaultdict(set)      # per port: every background address up to the merge day
    base = defaultdict(set)
    earlier = defaultdict(set)
    today = defaultdict(set)
    for r in sorted(bg, key=lambda r: (r["ts"], r["uid"])):
        if r["resp_p"] not in p.ports or ":" in r["orig_h"]:
            continue
        inside, outside = (r["orig_h"], r["resp_h"]) if r["orig_h"].startswith("147.32") else (r["resp_h"], r["orig_h"])
        port, second = r["resp_p"], int(r["ts"] - DAY0)
        d, tw = second // 86400 + 1, second % 86400 // p.tw_seconds
        seen[port].add(outside)
        if d == 1:
            base[port].add(outside)
        if d < 3:
            earlier[port].add(outside)
            continue
        known = base if mode == "base_day" else earlier
        is_new = outside not in known[port] and outside not in today[port]
        today[port].add(outside)
        state[(tw, port)].add(r, inside, outside, is_new)
    active, fresh = set(), defaultdict(set)
    for r in attack:
        tw = int(r["ts"]) // p.tw_seconds + p.offset_tw
        active.add(tw)
        for port in p.ports:
            is_new = r["resp_h"] not in seen[port] and r["resp_h"] not in fresh[port]
            fresh[port].add(r["resp_h"])
            state[(tw, port)].add(r, "147.32.9.9", r["resp_h"], is_new)
    for r in got:
        want = state[(r.timewindow, r.port)].row()
        assert r.label == (r.timewindow in active)
        assert [r[f] for f in FEATURES] == pytest.approx([want[f] for f in FEATURES], abs=1e-6), (r.timewindow, r.port)


def test_variants_are_overlaid_side_by_side(spark):
    p = Params(tw_seconds=3600, attackers=("192.168.1.114",))
    conns = conn_frame(spark, random_rows(300, seed=30))
    trace = trace_frame(spark, [{"ts": i * 60.0, "resp_h": f"198.51.0.{i}"} for i in range(40)])
    variants = overlay.prepared_variants(trace, p, [4])
    both = overlay.labelled_day(conns, variants, ["w", "4w"], day(3), p, day(1)).features
    alone = overlay.labelled_day(conns, variants, ["4w"], day(3), p, day(1)).features
    assert both.count() == 2 * 24 * 5
    pick = lambda df: sorted(map(str, df.filter("variant = '4w'").collect()))
    assert pick(both) == pick(alone)
    counts = {r.variant: r.n for r in both.filter("port = 22 and label").groupBy("variant").agg(F.sum("num_conns").alias("n")).collect()}
    assert counts["w"] - counts["4w"] == 30


def test_packed_redirections_give_the_same_days_and_repeat_no_record(spark):
    p = Params(tw_seconds=3600, attackers=("192.168.1.114", "192.168.1.50"), ports=(22, 80, 443))
    conns = conn_frame(spark, random_rows(300, seed=33))
    trace = trace_frame(spark, [{"ts": i * 1500.0, "resp_h": f"198.51.0.{i % 23}", "duration": float(i % 5), "conn_state": "S0",
                                 "orig_h": p.attackers[i % 3 == 0]} for i in range(70)])
    known = spark.createDataFrame([(day(1), 80, f"203.0.0.{i}") for i in range(9)] + [(day(1), 22, f"203.0.1.{i}") for i in range(4)],
                                  "day date, port int, ext_ip string")
    factors = [2, 4, 8]
    names = at.redirections(factors, p)
    plain = overlay.redirected_variants(trace, known, p, factors).drop("port", "n")
    packed = overlay.redirected_variants(trace, known, p, factors, packed=True)
    assert packed.filter("counted").count() == 70 and packed.count() <= 70 * (1 + len(p.ports))
    wanted = [f"{b}w" for b in names if b != names[2]]
    want = overlay.labelled_day(conns, plain, wanted, day(3), p, day(1))
    got = overlay.labelled_day(conns, packed, wanted, day(3), p, day(1), packed=names)
    rows = lambda df: sorted((str(r.variant), r.timewindow, r.port, r) for r in df.collect())
    a, b = rows(got.features), rows(want.features)
    assert [x[:3] for x in a] == [x[:3] for x in b] and len(a) == 8 * 24 * 3
    for x, y in zip(a, b):
        assert x[3].label == y[3].label and [x[3][f] for f in FEATURES] == pytest.approx([y[3][f] for f in FEATURES], abs=1e-9)
    assert sorted(map(tuple, got.dropped.collect())) == sorted(map(tuple, want.dropped.collect()))
    with pytest.raises(ValueError, match="at most"):
        at.history_variant(trace, known, list(range(2, 40)), p, packed=True)


def test_an_address_counts_once_in_a_window_that_comes_back_the_next_day(spark):
    p = Params(tw_seconds=3600, attackers=("192.168.1.114",))
    conns = conn_frame(spark, [{"ts": DAY0 + 2 * 86400 + 43300, "resp_h": "203.0.0.9", "resp_p": 22}])
    trace = trace_frame(spark, [{"ts": t, "resp_h": h} for t, h in ((0.0, "a"), (86400.0, "a"), (86401.0, "b"), (3600.0, "b"),
                                                                    (3601.0, "203.0.0.9"), (5.0, "203.0.0.9"))])
    mapping = spark.createDataFrame([(day(3), "192.168.1.114", "147.32.9.9")], "day date, attacker_ip string, int_ip string")
    rows = at.merge_overlay(conns, trace, mapping, ["w"], day(3), p, day(1)).filter("label").collect()
    got = {(r.timewindow, r.port): (r.external_ips, r.new_external_ips, r.internal_ips) for r in rows}
    assert got[12, 22] == (3, 2, 2) and got[12, 80] == (3, 2, 1)
    assert got[13, 22] == (2, 1, 1) and got[13, 80] == (2, 1, 1)


def test_attackers_take_hosts_of_one_subnet(spark):
    conns = conn_frame(spark, random_rows(300, seed=31))
    mapping = overlay.attacker_mapping(conns, day(2), P).collect()
    assert {r.attacker_ip for r in mapping} == set(P.attackers)
    assert len({r.int_ip for r in mapping}) == 2 and len({r.int_ip.rsplit(".", 1)[0] for r in mapping}) == 1


def test_propagation_rate_counts_active_windows_only(spark):
    p = Params(attackers=("192.168.1.114",))
    trace = trace_frame(spark, [{"ts": 0.0, "resp_h": "a"}, {"ts": 1.0, "resp_h": "b"}, {"ts": 600.0, "resp_h": "a"}])
    mapping = spark.createDataFrame([(day(3), "192.168.1.114", "147.32.9.9")], "day date, attacker_ip string, int_ip string")
    r = at.propagation_rate(at.attack_window_features(at.place_attack(trace, mapping, day(3), p))).first()
    assert (r.ips_per_window, r.active_windows) == (1.5, 2)


def test_attacker_without_a_host_fails(spark):
    trace = trace_frame(spark, [{"ts": 0.0, "resp_h": "a"}])
    nobody = spark.createDataFrame([(day(2), "192.168.1.114", "147.32.9.9")], "day date, attacker_ip string, int_ip string")
    with pytest.raises(Exception, match="no background host for attacker"):
        at.place_attack(trace, nobody, day(3), P).collect()


def test_rows_behind_the_merge_day_are_counted(spark):
    p = Params(tw_seconds=3600, attackers=("192.168.1.114",))
    conns = conn_frame(spark, random_rows(300, seed=30))
    trace = trace_frame(spark, [{"ts": i * 3600.0, "resp_h": f"198.51.0.{i}"} for i in range(20)])
    merged = overlay.labelled_day(conns, trace, ["w"], day(3), p, day(1))
    assert [tuple(r) for r in merged.dropped.collect()] == [("w", 8)]
    assert merged.features.filter("port = 22 and label").count() == 12


def test_day_split_table_is_pruned(spark, tmp_path):
    rows = conn_frame(spark, random_rows(200, seed=3))
    conn_log.split_by_day(rows, P, str(tmp_path / "t"))
    table = conn_log.scan_day(spark, str(tmp_path / "t"))
    one = ft.day_filter(table, day(2), P)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert one.count() == ft.day_filter(ft.port_prefilter(rows, P), day(2), P).count() > 0


def test_history_list_has_each_position_once(spark):
    rows = ft.profiled_connections(conn_frame(spark, random_rows(500, seed=9)), P)
    listed = hs.history_list(hs.history_by_day_port(rows))
    sizes = {r.port: (r.n, r.top) for r in listed.groupBy("port").agg(
        F.count_distinct("position").alias("n"), F.max("position").alias("top")).collect()}
    assert all(n == top + 1 for n, top in sizes.values()) and np.prod([n for n, _ in sizes.values()]) > 0
