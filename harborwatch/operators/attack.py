"""Attack traces: cleaning, thinning, redirection and overlay onto a background day."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.functions import fields as f
from harborwatch.operators import features as ft
from harborwatch.operators.history import history_by_day_port, history_list
from harborwatch.operators.ordering import ordinals, running_totals
from harborwatch.schema import FEATURES, Params
from harborwatch.session import cut_lineage

# Thinned trace columns that identify a record's place in the trace.
TRACE_ORDER = ["ts", "uid"]
# Variants that a packed trace can hold: bits of ``members``.
PACKED = 62


# --- trace preparation ---------------------------------------------------------

def attack_row_filter(trace: DataFrame, p: Params) -> DataFrame:
    return trace.filter(F.col("orig_h").isin(list(p.attackers)) & (F.col("resp_p") == p.attack_port))


def drop_internal_only_sources(trace: DataFrame, p: Params, few: bool = False) -> DataFrame:
    """Keep sources that contact at least one destination outside the attack network.

    ``few``: the trace holds the sources of a given list only. They go to the records then, which a shuffle by source would
    bring to as many tasks as there are sources.
    """
    outward = trace.filter(~F.col("resp_h").startswith(p.attack_prefix)).select("variant", "orig_h").distinct()
    return trace.join(F.broadcast(outward) if few else outward, ["variant", "orig_h"], "left_semi")


def remap_internal_dst(trace: DataFrame, p: Params) -> DataFrame:
    """Each (source, internal destination) gets one stable public address.

    The address is a function of the pair, so no mapping table has to be joined back.
    """
    public = f.random_public_ip(p.seed, F.col("orig_h"), F.col("resp_h"))
    internal = F.col("resp_h").startswith(p.attack_prefix)
    return trace.withColumn("resp_h", F.when(internal, public).otherwise(F.col("resp_h")))


def relative_time(trace: DataFrame) -> DataFrame:
    """ts relative to the first record of the variant (one row per named variant is broadcast)."""
    first = counted_rows(trace).groupBy("variant").agg(F.min("ts").alias("_first_ts"))
    return trace.join(F.broadcast(first), "variant").withColumn("ts", F.col("ts") - F.col("_first_ts")).drop("_first_ts")


def prepare_attack(trace: DataFrame, p: Params) -> DataFrame:
    attack = drop_internal_only_sources(attack_row_filter(trace, p), p, few=True)
    return relative_time(remap_internal_dst(attack, p))


# --- evasive variants ------------------------------------------------------------

def thin_variant(trace: DataFrame, factors: list[int]) -> DataFrame:
    """Keep every n-th record of each source, for each n; one output variant per n."""
    counted = ordinals(trace, TRACE_ORDER, {"_nth": ["variant", "orig_h"]})
    n = F.explode(F.array(*[F.lit(x) for x in factors])).alias("n")
    return (
        counted.select("*", n).filter(F.col("_nth") % F.col("n") == 0)
        .withColumn("variant", F.concat(F.col("n").cast("string"), F.col("variant")))
        .drop("_nth")
    )


def cycle_history_ip(records: DataFrame, history: DataFrame, ordinal: str) -> DataFrame:
    """Add ``cycled_ip``: entry ``ordinal % length`` of the port's history list.

    Every (port, position) exists once, so a long trace may be split freely on the record side.
    """
    # One row per port.
    lengths = F.broadcast(history.groupBy("port").agg(F.count(F.lit(1)).alias("_length")))
    listed = history_list(history).select("port", F.col("position").alias("_position"),
                                          F.col("ext_ip").alias("cycled_ip"))
    return (
        records.join(lengths, "port", "left")
        .withColumn("_position", F.col(ordinal) % F.col("_length"))
        .join(listed, ["port", "_position"], "left")
        .drop("_position", "_length")
    )


def redirections(factors: list[int], p: Params) -> list[str]:
    """What ``history_variant`` puts before a trace's name, in the order of the bits of its packed form."""
    return [f"port_{port}_history{n}_" for port in p.ports for n in factors]


def history_variant(trace: DataFrame, history: DataFrame, factors: list[int], p: Params, packed: bool = False) -> DataFrame:
    """Per port and n: every n-th record of a source is kept, the others go to addresses the port knows.

    Variants differ in destinations only. The packed form repeats no record for them: one row holds the whole record with
    ``counted`` set, and one narrow row per port its other destination. ``members`` tells which of ``redirections`` (bits)
    go to the row's destination; ``variant`` stays the trace's name.
    """
    one = F.lit(1).cast("long")
    counted = running_totals(trace, TRACE_ORDER, {
        "_nth": (["variant", "orig_h"], one), "_ordinal": (["variant"], one)})
    if packed:
        return _packed_history(counted, history, factors, p)
    ports = F.explode(F.array(*[F.lit(x) for x in p.ports])).alias("port")
    cycled = cycle_history_ip(counted.select("*", ports), history, "_ordinal")
    n = F.explode(F.array(*[F.lit(x) for x in factors])).alias("n")
    kept = F.col("_nth") % F.col("n") == 0
    return (
        cycled.select("*", n)
        .withColumn("resp_h", F.when(kept | F.col("cycled_ip").isNull(), F.col("resp_h")).otherwise(F.col("cycled_ip")))
        .withColumn("variant", F.concat(F.lit("port_"), F.col("port").cast("string"), F.lit("_history"),
                                        F.col("n").cast("string"), F.lit("_"), F.col("variant")))
        .drop("_nth", "_ordinal", "cycled_ip")
    )


def _packed_history(counted: DataFrame, history: DataFrame, factors: list[int], p: Params) -> DataFrame:
    if len(p.ports) * len(factors) > PACKED:
        raise ValueError(f"a packed trace holds at most {PACKED} variants")
    kept = [F.col("_nth") % n == 0 for n in factors]
    none = F.lit(0).cast("long")

    def members(ports: range, keeps: bool) -> Column:
        bits = [sum(1 << (i * len(factors) + j) for i in ports) for j in range(len(factors))]
        return reduce(add, [F.when(k if keeps else ~k, F.lit(b).cast("long")).otherwise(none) for k, b in zip(kept, bits)])

    whole = counted.withColumns({"members": members(range(len(p.ports)), True), "counted": F.lit(True)})
    sent = F.inline(F.array(*[F.struct(F.lit(port).alias("port"), members(range(i, i + 1), False).alias("members"))
                              for i, port in enumerate(p.ports)]))
    away = counted.select("variant", "ts", "orig_h", "resp_h", "_ordinal", sent).filter("members != 0")
    cycled = cycle_history_ip(away, history, "_ordinal").select(
        "variant", "ts", "orig_h", F.coalesce("cycled_ip", "resp_h").alias("resp_h"), "members", F.lit(False).alias("counted"))
    return whole.drop("_nth", "_ordinal").unionByName(cycled, allowMissingColumns=True)


def counted_rows(trace: DataFrame) -> DataFrame:
    """Every record once: of a packed trace, the rows that hold whole records."""
    return trace.filter("counted") if "counted" in trace.columns else trace


def chosen_variants(trace: DataFrame, variants: list[str], packed: list[str] | None = None) -> DataFrame:
    """Rows of the given variants; ``packed`` names the bits of a packed trace (``redirections``)."""
    if packed is None:
        return trace.filter(F.col("variant").isin(variants))
    wanted: dict[str, int] = {}
    for i, before in enumerate(packed):
        for v in variants:
            if v.startswith(before):
                wanted[v[len(before):]] = wanted.get(v[len(before):], 0) | 1 << i
    bits = F.lit(0).cast("long")
    for name, mask in wanted.items():
        bits = F.when(F.col("variant") == name, F.lit(mask).cast("long")).otherwise(bits)
    return trace.filter(F.col("variant").isin(list(wanted))).withColumn("members", F.col("members").bitwiseAND(bits))


def named_variants(rows: DataFrame, variants: list[str], packed: list[str] | None = None) -> DataFrame:
    """Rows per name of a trace, repeated for every chosen variant that holds its records."""
    if packed is None:
        return rows
    others = [c for c in rows.columns if c != "variant"]
    return rows.select(*others, F.explode(F.array(*[F.lit(b) for b in packed])).alias("_before"), "variant").select(
        F.concat("_before", "variant").alias("variant"), *others).filter(F.col("variant").isin(variants))


# --- overlay -----------------------------------------------------------------------

def attack_window(trace: DataFrame, p: Params) -> DataFrame:
    """Window on the merge day. ``seq`` grows with time even where the window number wraps at 24 h."""
    since = F.floor(F.col("ts"))
    rows = relative_time(trace).withColumn("seq", F.floor(since / p.tw_seconds))
    wrapped = F.floor(F.pmod(since, F.lit(86400)) / p.tw_seconds) + p.offset_tw
    return rows.withColumn("timewindow", wrapped.cast("int"))


def past_midnight_rows(windowed: DataFrame, p: Params) -> DataFrame:
    """Rows that fall outside the merge day and are left out of the overlay, per variant."""
    return counted_rows(windowed).groupBy("variant").agg(
        F.count_if(F.col("timewindow") >= p.tw_per_day).alias("dropped_rows"))


def map_attackers(hosts: DataFrame, chosen: DataFrame, p: Params) -> DataFrame:
    """Attacker address -> background address of the chosen /24 (both sides numbered, then matched).

    A /24 has at most 256 hosts; the attacker list is a parameter.
    """
    in_chosen = hosts.join(F.broadcast(chosen.filter(F.col("choice") == 1).select("day", "subnet24")),
                           ["day", "subnet24"])
    by_hash = W.partitionBy("day", "subnet24").orderBy(f.seeded_order(p.seed, F.col("int_ip")), "int_ip")
    numbered = in_chosen.withColumn("place", F.row_number().over(by_hash))
    attackers = F.posexplode(F.array(*[F.lit(a) for a in p.attackers])).alias("_at", "attacker_ip")
    wanted = chosen.select("day").distinct().select("day", attackers).withColumn("place", F.col("_at") + 1)
    return numbered.join(F.broadcast(wanted), ["day", "place"]).select("day", "attacker_ip", "int_ip")


def place_attack(trace: DataFrame, mapping: DataFrame, merge_day: date, p: Params) -> DataFrame:
    """Attack records on the merge day, seen as coming from the mapped background hosts.

    Fails when a source of the trace has no host on that day.
    """
    placed = attack_window(trace, p).filter(F.col("timewindow") < p.tw_per_day)
    hosts = mapping.filter(F.col("day") == F.lit(merge_day)).select(F.col("attacker_ip").alias("orig_h"), "int_ip")
    host = F.coalesce("int_ip", F.raise_error(F.concat(F.lit("no background host for attacker "), "orig_h")).cast("string"))
    return placed.join(F.broadcast(hosts), "orig_h", "left").select(
        "variant", F.lit(merge_day).alias("day"), "timewindow", "seq", host.alias("int_ip"),
        F.col("resp_h").alias("ext_ip"), *ft.MEASURES, "conn_state", *[c for c in ("members", "counted") if c in placed.columns])


def overlay_all_ports(rows: DataFrame, p: Params) -> DataFrame:
    """The trace counts on every port, whatever port it attacked."""
    return rows.select("*", F.explode(F.array(*[F.lit(x) for x in p.ports])).alias("port"))


def attack_window_features(placed: DataFrame) -> DataFrame:
    """Attack traffic alone: per variant and window, without the history-based count."""
    key = ["variant", "timewindow"]
    peers = ft.window_peers(placed, key).groupBy(*key).agg(
        F.count_if(F.col("external")).alias("external_ips"), F.count_if(~F.col("external")).alias("internal_ips"))
    return ft.traffic_statistics(placed, key).join(peers, key)


def propagation_rate(attack_features: DataFrame) -> DataFrame:
    """Mean distinct external addresses per active attack window."""
    return attack_features.groupBy("variant").agg(
        F.avg("external_ips").alias("ips_per_window"), F.count(F.lit(1)).alias("active_windows"))


def _per_variant(rows: DataFrame, variants: list[str]) -> DataFrame:
    return rows.select("*", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))


def _overlay_peers(
    background: DataFrame, placed: DataFrame, known: DataFrame, variants: list[str], p: Params, base_day: date,
    packed: list[str] | None = None,
) -> DataFrame:
    """Peer counts of the merge day's background and attack together, per (variant, window, port).

    Background addresses are new by the background rule; attack addresses are new when no background day up
    to and including the merge day has seen them on the port. ``known`` holds the addresses of earlier days,
    reduced to one row per (port, address) whatever the number of days and variants.

    Addresses of the attack are not repeated for ports, and those of a packed trace not for variants: an address meets once
    what the background knows of it, and only counts per window are repeated. An address of both sides counts as background.
    """
    past = known.groupBy("port", F.col("ext_ip").alias("ip")).agg(
        F.max(F.col("day") == F.lit(base_day)).alias("in_base")).filter("ip IS NOT NULL").withColumn("external", F.lit(True))
    today = ft.window_peers(background)
    marked = today.join(past, ["port", "external", "ip"], "left").withColumn(
        "first", F.min("timewindow").over(W.partitionBy("port", "external", "ip")))
    earlier = F.col("in_base").isNotNull()
    bg_known = F.coalesce("in_base", F.lit(False)) if p.history_mode == "base_day" else earlier
    bg_new = (F.col("timewindow") == F.col("first")) & ~bg_known
    alone = marked.groupBy("day", "timewindow", "port").agg(
        F.count_if(F.col("external")).alias("external_ips"),
        F.count_if(F.col("external") & bg_new).alias("new_external_ips"),
        F.count_if(~F.col("external")).alias("internal_ips"))

    # Per address: ports that have seen it, and its windows of the merge day.
    seen = past.select("external", "ip", "port", F.lit(None).cast("int").alias("timewindow")).unionByName(
        today.select("external", "ip", "port", "timewindow"))
    at = F.when(F.col("timewindow").isNotNull(), F.struct("timewindow", "port"))
    seen = seen.groupBy("external", F.col("ip").alias("_ip")).agg(
        F.sort_array(F.collect_set("port")).alias("known"), F.collect_list(at).alias("at")).withColumnRenamed("external", "_external")

    if packed is None:
        packed, placed = [""], placed.withColumn("members", F.lit(1).cast("long"))
    window = ["variant", "day", "timewindow", "seq"]
    hits = ft.peer_rows(placed.filter("members != 0"), [*window, "members"]).groupBy(*window, "external", "ip").agg(
        F.bit_or("members").alias("members"))

    def unseen(*keys: str) -> Column:
        """Members that no earlier row of the same keys has."""
        before = W.partitionBy("external", "ip", "variant", *keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
        return F.col("members").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("members").over(before), F.lit(0).cast("long"))))

    here = F.sort_array(F.transform(F.filter("at", lambda a: a["timewindow"] == F.col("timewindow")), lambda a: a["port"]))
    no_port = F.array().cast("array<int>")
    alike = ["variant", "day", "timewindow", "external", "present", "new", "known", "here"]
    hits = hits.withColumns({"present": unseen("timewindow"), "new": unseen()}).join(
        seen, (F.col("external") == F.col("_external")) & F.col("ip").eqNullSafe(F.col("_ip")), "left").withColumns({
            "known": F.coalesce("known", no_port), "here": F.coalesce(here, no_port)}).groupBy(*alike).agg(
        F.count(F.lit(1)).alias("ips"))
    each = F.posexplode(F.array(*[F.lit(b) for b in packed])).alias("_bit", "_before")
    has = lambda c: F.expr(f"shiftright({c}, _bit) & 1 = 1")
    alike = ["variant", "day", "timewindow", "external", "new", "known", "here"]
    by_variant = hits.select("*", each).filter(has("present")).select(
        F.concat("_before", "variant").alias("variant"), "day", "timewindow", "external", has("new").alias("new"), "known", "here",
        "ips").filter(F.col("variant").isin(variants)).groupBy(*alike).agg(F.sum("ips").alias("ips"))
    more = lambda c: F.coalesce(F.sum(F.when(c, F.col("ips"))), F.lit(0))
    added = ~F.array_contains("here", F.col("port"))
    key = ["variant", "day", "timewindow", "port"]
    attack = overlay_all_ports(by_variant, p).groupBy(*key).agg(
        more(F.col("external") & added).alias("external_ips"),
        more(F.col("external") & F.col("new") & ~F.array_contains("known", F.col("port"))).alias("new_external_ips"),
        more(~F.col("external") & added).alias("internal_ips"))
    counts = ["external_ips", "new_external_ips", "internal_ips"]
    return _per_variant(alone, variants).unionByName(attack).groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts])


def merge_overlay(
    conns: DataFrame, trace: DataFrame, mapping: DataFrame, variants: list[str], merge_day: date, p: Params,
    base_day: date, known: DataFrame | None = None, packed: list[str] | None = None,
) -> DataFrame:
    """Labelled, dense feature rows of the merge day, one set per variant, with the attack on every port.

    Merging the statistics of both equals continuing the background accumulators with the attack.
    ``known`` is a stored history (day, port, ext_ip); without it the earlier days are read from ``conns``.
    ``packed`` names the bits of a packed trace.
    """
    start, _ = f.day_bounds(base_day, p.report_tz)
    dawn, dusk = f.day_bounds(merge_day, p.report_tz)
    background = ft.profiled_connections(ft.between(conns, dawn, dusk, p), p)
    if known is None:
        earlier = ft.between(conns, start, dawn, p)
        known = history_by_day_port(ft.profiled_connections(earlier, p))
    else:
        known = known.filter((F.col("day") >= F.lit(base_day)) & (F.col("day") < F.lit(merge_day)))
    placed = place_attack(chosen_variants(trace, variants, packed), mapping, merge_day, p)
    if packed is None:
        # Used for statistics and peers: mapped and placed once. A packed trace would write a row per record and port.
        placed = cut_lineage(placed)
    key = ["variant", "day", "timewindow", "port"]

    # Records are aggregated once; only window rows are repeated for variants and ports. At most a day of windows per variant,
    # used for statistics and labels.
    attacked = named_variants(cut_lineage(ft.traffic_partials(counted_rows(placed), ["variant", "day", "timewindow"])), variants, packed)
    stats = ft.merge_traffic(
        _per_variant(ft.traffic_partials(background), variants), overlay_all_ports(attacked, p), key)
    peers = _overlay_peers(background, placed, known, variants, p, base_day, packed)
    days = _per_variant(conns.sparkSession.range(1).select(F.lit(merge_day).alias("day")), variants)
    dense = ft.densify(stats.join(peers, key), days, p, keys=("variant", "day"))
    return label_windows(dense, attacked).select(*key, *FEATURES, "label")


def label_windows(features: DataFrame, placed: DataFrame) -> DataFrame:
    """label = the window has at least one attack record."""
    active = placed.select("variant", "day", "timewindow").distinct().withColumn("_hit", F.lit(True))
    return features.join(active, ["variant", "day", "timewindow"], "left").withColumn(
        "label", F.col("_hit").isNotNull()).drop("_hit")
