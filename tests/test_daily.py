"""Daily runs on a stored table of first sightings against the window over all days."""

import random
import uuid

import pytest

from harborwatch.operators import features as ft
from harborwatch.operators import history as hs
from harborwatch.plans import daily
from harborwatch.schema import Params
from harborwatch.session import work_path
from harborwatch.sources import tables
from tests.helpers import DAY, DAY0, conn_frame, day

P = Params(history_mode="cumulative", tw_seconds=3600)


@pytest.fixture
def name(spark):
    made = f"seen_{uuid.uuid4().hex}"
    tables.first_seen_table(spark, made, work_path(spark, "seen"), buckets=3)
    yield made
    spark.sql(f"DROP TABLE {made}")


@pytest.fixture(scope="module")
def conns(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):  # one address has a third of all connections
        host = 1 if rng.random() < 0.33 else rng.randrange(2, 60)
        rows.append({"ts": DAY0 + rng.randrange(6) * DAY + rng.randrange(86400), "resp_h": f"203.0.0.{host}",
                     "resp_p": rng.choice([22, 80, 443])})
    return conn_frame(spark, rows).cache()


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def _expected(conns, days):
    return _rows(ft.window_features(conns, P, day(1)).filter(ft.F.col("day").isin(days)))


def test_runs_day_by_day_equal_the_window_over_all_days(spark, conns, name):
    days = [day(n) for n in range(1, 7)]
    daily.record_first_seen(conns, days[:3], name, P)
    for d in days[3:]:
        daily.record_first_seen(conns, [d], name, P)
        assert _rows(daily.recorded_features(conns, [d], name, P)) == _expected(conns, [d])
    assert _rows(daily.recorded_features(conns, days[1:], name, P)) == _expected(conns, days[1:])
    table = spark.table(name).filter("port IS NOT NULL")
    assert table.count() == table.select("port", "ext_ip").distinct().count()


def test_a_day_may_run_again_and_a_late_day_may_follow(spark, conns, name):
    late = conns.filter(ft.F.col("ts") >= DAY0 + DAY)
    for d in (2, 3, 3):
        daily.record_first_seen(late, [day(d)], name, P)
    once = spark.table(name).count()
    daily.record_first_seen(late, [day(3)], name, P)
    assert spark.table(name).count() == once
    for d in (1, 2, 3):  # the first day arrives, the others are run again
        daily.record_first_seen(conns, [day(d)], name, P)
    days = [day(2), day(3)]
    assert _rows(daily.recorded_features(conns, days, name, P)) == _expected(conns, days)


def test_days_without_rows_leave_a_mark_and_clear_their_folder(spark, conns, name):
    daily.record_first_seen(conns, [day(2)], name, P)
    daily.record_first_seen(conns.limit(0), [day(2)], name, P)
    daily.record_first_seen(conns.limit(0), [], name, P)
    assert _rows(spark.table(name)) == [(None, None, None, day(2))]
    assert daily.recorded_features(conns.limit(0), [day(2)], name, P).count() == 0


def test_another_session_finds_the_table(spark, conns):
    path, names = work_path(spark, "seen"), [f"seen_{uuid.uuid4().hex}" for _ in range(2)]
    tables.first_seen_table(spark, names[0], path, buckets=3)
    daily.record_first_seen(conns, [day(1)], names[0], P)
    tables.first_seen_table(spark, names[1], path, buckets=3)
    assert spark.table(names[1]).count() == spark.table(names[0]).count() > 1
    assert tables.first_seen_buckets(spark, names[1]) == 3


def test_the_table_is_neither_shuffled_nor_read_beyond_the_day(spark, conns, name):
    daily.record_first_seen(conns, [day(1), day(2)], name, P)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = ft.profiled_connections(conns, P)
        found = hs.unseen(hs.first_sightings(rows), spark.table(name).filter(ft.F.col("first_day") < ft.F.lit(day(2))), 3)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert "SelectedBucketsCount: 3 out of 3" in plan and "PartitionFilters: [isnotnull(first_day" in plan
    # Both exchanges lie below the sightings; between the join and the table there is a sort only.
    assert "Exchange" not in plan[plan.rindex("InMemoryRelation"):]
