"""Labelled test days: raw attack trace -> prepared trace and variants -> overlay on a background day."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame

from harborwatch.operators import attack, features, history
from harborwatch.schema import THINNING, Params
from harborwatch.session import cut_lineage


class LabelledDay(NamedTuple):
    features: DataFrame
    dropped: DataFrame


def prepared_variants(raw_trace: DataFrame, p: Params, factors: list[int] = THINNING) -> DataFrame:
    """The prepared trace and its thinned versions, told apart by ``variant``."""
    prepared = attack.prepare_attack(raw_trace, p)
    return prepared.unionByName(attack.thin_variant(prepared, factors).drop("n"))


def attacker_mapping(conns: DataFrame, merge_day: date, p: Params) -> DataFrame:
    """Attackers as hosts of a chosen subnet of the merge day."""
    today = features.profiled_connections(features.day_filter(conns, merge_day, p), p)
    hosts = history.subnet_hosts(today)
    chosen = history.choose_subnets(history.subnet_sizes(hosts), p)
    return attack.map_attackers(hosts, chosen, p)


def labelled_day(conns: DataFrame, trace: DataFrame, variants: list[str], merge_day: date, p: Params,
                 base_day: date, known: DataFrame | None = None, packed: list[str] | None = None) -> LabelledDay:
    """With a stored history (``known``) only the merge day of ``conns`` is read.

    ``packed`` names the bits of a packed trace (``attack.redirections``).
    ``dropped`` counts, per variant, the attack records that fall behind the merge day and are in no window.
    """
    # At most one row per attacker; read by every use of the trace.
    mapping = cut_lineage(attacker_mapping(conns, merge_day, p))
    dropped = attack.past_midnight_rows(attack.attack_window(attack.chosen_variants(trace, variants, packed), p), p)
    return LabelledDay(
        attack.merge_overlay(conns, trace, mapping, variants, merge_day, p, base_day, known, packed),
        attack.named_variants(dropped, variants, packed))


def redirected_variants(prepared: DataFrame, known: DataFrame, p: Params, factors: list[int] = THINNING,
                        packed: bool = False) -> DataFrame:
    """Traces that contact addresses already in the history, per port and factor; packed: no record is repeated for them."""
    return attack.history_variant(prepared, known, factors, p, packed)
