"""Persisted state per day: known external addresses and internal hosts by subnet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.functions import fields as f
from harborwatch.operators.ordering import running_totals
from harborwatch.schema import Params


def history_by_day_port(rows: DataFrame) -> DataFrame:
    """Distinct external addresses per day and port."""
    return rows.select("day", "port", "ext_ip").distinct()


def new_external(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct (day, port, address) that no earlier history row has on the port."""
    known = history.select("port", "ext_ip").distinct()
    return history_by_day_port(rows).join(known, ["port", "ext_ip"], "left_anti").select("day", "port", "ext_ip")


def first_seen(rows: DataFrame) -> DataFrame:
    """Earliest record of every (day, port, external address), by (ts, uid)."""
    first = F.min(F.struct("ts", "uid", "timewindow")).alias("first")
    return rows.groupBy("day", "port", "ext_ip").agg(first).select(
        "day", "port", "ext_ip", "first.ts", "first.uid", "first.timewindow")


def first_sightings(rows: DataFrame) -> DataFrame:
    """One row per (port, external address): the first day and window of ``rows`` that has it; a null address is ''."""
    first = F.min(F.struct("day", "timewindow")).alias("first")
    return rows.groupBy("port", F.coalesce("ext_ip", F.lit("")).alias("ext_ip")).agg(first).select(
        "port", "ext_ip", "first.timewindow", F.col("first.day").alias("first_day"))


def unseen(sightings: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """The sightings whose (port, address) ``known`` does not hold.

    Sightings, one row per key, are dealt like the buckets of ``known``, which stays where it is. An anti-join would be moved
    below the dealing and shuffle both sides; the outer join stays above it.
    """
    dealt = sightings.repartition(buckets, "port", "ext_ip")
    held = known.select("port", "ext_ip", F.lit(True).alias("_held"))
    return dealt.join(held, ["port", "ext_ip"], "left").filter(F.col("_held").isNull()).select(*sightings.columns)


def history_list(history: DataFrame) -> DataFrame:
    """All days' addresses per port with a 0-based position ordered by (day, address)."""
    listed = running_totals(history, ["port", "day", "ext_ip"], {"position": (["port"], F.lit(1).cast("long"))})
    return listed.select("port", (F.col("position") - 1).alias("position"), "day", "ext_ip")


def subnet_hosts(rows: DataFrame) -> DataFrame:
    """Distinct internal addresses with their /24, per day."""
    return rows.select("day", f.subnet24(F.col("int_ip")).alias("subnet24"), "int_ip").distinct()


def subnet_sizes(hosts: DataFrame) -> DataFrame:
    return hosts.groupBy("day", "subnet24").agg(F.count(F.lit(1)).alias("n_ips"))


def network_rollup(sizes: DataFrame) -> DataFrame:
    """Per /16: number of /24 subnets and of addresses, with its rank by address count (ties: by name).

    A day has at most 65,536 /16 networks.
    """
    by16 = sizes.groupBy("day", f.subnet16(F.col("subnet24")).alias("subnet16")).agg(
        F.count(F.lit(1)).alias("n_subnets"), F.sum("n_ips").alias("n_ips"))
    largest_first = W.partitionBy("day").orderBy(F.desc("n_ips"), "subnet16")
    return by16.withColumn("size_rank", F.row_number().over(largest_first))


def find_network(sizes: DataFrame, rank: int = 4) -> DataFrame:
    """CIDR text of the rank-th largest /16."""
    return network_rollup(sizes).filter(F.col("size_rank") == rank).select(
        "day", F.concat("subnet16", F.lit("0.0/16")).alias("network"))


def eligible_subnets(sizes: DataFrame, p: Params, min_hosts: int) -> DataFrame:
    """/24 subnets inside the network that have enough hosts."""
    address = f.ip_number(F.concat("subnet24", F.lit("0")))
    return sizes.filter(f.in_cidr(address, p.network) & (F.col("n_ips") >= min_hosts))


def choose_subnets(sizes: DataFrame, p: Params, min_hosts: int | None = None, k: int = 1) -> DataFrame:
    """k eligible subnets per day in seeded order; the job fails when a day has fewer.

    A subnet must hold at least as many hosts as there are attackers to map.
    """
    eligible = eligible_subnets(sizes, p, len(p.attackers) if min_hosts is None else min_hosts)
    # A /16 network has at most 256 subnets, so a day is a small group.
    w = W.partitionBy("day")
    counted = eligible.withColumns({
        "choice": F.row_number().over(w.orderBy(f.seeded_order(p.seed, F.col("subnet24")), "subnet24")),
        "available": F.count(F.lit(1)).over(w),
    })
    # A day without any eligible subnet has a row too, so that it fails instead of vanishing.
    ranked = sizes.select("day").distinct().join(counted, "day", "left").select(*counted.columns)
    enough = F.when(F.col("available") >= k, F.col("choice")).otherwise(
        F.raise_error(F.lit("too few eligible subnets")).cast("int"))
    return ranked.withColumn("choice", enough).filter(F.col("choice") <= k).drop("available")
