"""Pieces of SQL text that the oracles share."""

from __future__ import annotations


def km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Great-circle kilometres, as ``functions.geo.haversine_km`` has them."""
    lat1, lng1, lat2, lng2 = (f"({x})" for x in (lat1, lng1, lat2, lng2))
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(6371e0 * 2e0 * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def half_up(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def pct(part: str, whole: str, digits: int = 0) -> str:
    share = half_up(f"({part}) / cast({whole} as double) * 100e0", digits)
    return f"case when ({whole}) > 0 then {share} end"


def first_match(text: str, rules, default: str | None = None) -> str:
    """The label of the first pattern that is found in ``text``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"when regexp_matches({text}, {quote('(?i)' + p)}) then {quote(label)}" for label, p in rules)
    return f"case {cases}" + (f" else {quote(default)}" if default is not None else "") + " end"


def severity_counts(alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(f"count(*) filter (where {dot}severity = '{s}') as {s}" for s in ("fatal", "serious", "minor"))
