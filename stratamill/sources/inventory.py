"""Which other timeframes a strategy can ask for: an inventory is admitted before any trial runs."""

from __future__ import annotations

import re

from stratamill.failures import Failure
from stratamill.plans.space import Categorical, Space
from stratamill.sources.bars import timeframe
from stratamill.types import Refusal

#: Names of the format (fixed values): an inventory's fields, and those of each kind of entry.
FIELDS = {"schema", "source_sha256", "artifact_sha256", "primary_chart_timeframe", "entries"}
ENTRIES = {"token": {"kind", "timeframe"}, "input": {"kind", "key", "default"}, "unknown": {"kind"}}
_DIGEST = re.compile("[0-9a-f]{64}")


def token(text) -> str | None:
    """The one spelling of a timeframe; None if it's none."""
    if not isinstance(text, str):
        return None
    try:
        n, unit = timeframe({"D": "1D", "W": "1W", "M": "1M"}.get(text, text))
    except Refusal:
        return None
    return f"{n}{'' if unit == 'm' else unit}"


def _refuse(reason: str) -> None:
    raise Failure("hpo_walkforward_inventory_invalid", capability="selected_window_request_feed_inventory", reason=reason)


def _well_formed(inventory) -> bool:
    if not isinstance(inventory, dict) or set(inventory) != FIELDS or not isinstance(inventory["entries"], list):
        return False
    digests = [inventory["source_sha256"], *([] if inventory["artifact_sha256"] is None else [inventory["artifact_sha256"]])]
    named = [] if inventory["primary_chart_timeframe"] is None else [inventory["primary_chart_timeframe"]]
    for e in inventory["entries"]:
        if not isinstance(e, dict) or set(e) != ENTRIES.get(e.get("kind")):
            return False
        if e["kind"] == "token":
            named.append(e["timeframe"])
        if e["kind"] == "input" and not (isinstance(e["key"], str) and isinstance(e["default"], str)):
            return False
    return all(isinstance(d, str) and _DIGEST.fullmatch(d) for d in digests) and all(token(x) == x for x in named)


def admit(inventory: dict | None, source: str, artifact: str, chart: str, supported: set[str], fixed: dict | None = None, space: Space | None = None) -> list[str]:
    """All timeframes that any choice of the inputs can ask for, in order; refused if one can't be told or isn't supported."""
    if inventory is None:
        _refuse("missing")
    if not _well_formed(inventory):
        _refuse("invalid")
    if inventory["artifact_sha256"] is None:
        _refuse("unbound")
    if (inventory["source_sha256"], inventory["artifact_sha256"]) != (source, artifact):
        _refuse("artifact_mismatch")
    if inventory["primary_chart_timeframe"] not in (None, token(chart)):
        _refuse("chart_mismatch")
    searched, reached = {d.name: d for d in (space.dimensions if space else ())}, set()
    for e in inventory["entries"]:
        if e["kind"] == "unknown":
            _refuse("unknown")
        elif e["kind"] == "token":
            values = [e["timeframe"]]
        elif e["key"] in searched:  # every choice, whatever the others are; a number is no timeframe
            d = searched[e["key"]]
            values = d.choices if isinstance(d, Categorical) else [None]
        else:
            values = [(fixed or {}).get(e["key"], e["default"])]
        found = {token(v) for v in values}
        if None in found:
            _refuse("input_unresolved")
        reached |= found
    if reached - supported:
        raise Failure("hpo_walkforward_timeframe_unsupported", capability="selected_window_request_feed_timeframe")
    return sorted(reached)
