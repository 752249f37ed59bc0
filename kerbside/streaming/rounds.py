"""Dispatch of an alert as a machine: rounds of hospitals with a time to answer, acceptance, release
and re-dispatch, exhaustion, and arrival times that are routed anew at most every 30 seconds."""

from __future__ import annotations

import math

#: Rounds, ms of a round, ms between routed arrival times, stages in their order, and the
#: most that an arrival time grows between two of these.
ROUNDS, ROUND_MS, REFRESH_MS, STAGES, MOST_GROWTH = 3, 90_000, 30_000, ("accepted", "dispatched", "on_scene", "transporting", "closed"), 1.5
NO_ANSWER, NONE_LEFT = "no hospital accepted in time", "no emergency-capable hospital left in range"
SCHEMA = "alert_id long, at_ms long, kind string, round_no int, hospital_id long, detail string"
FIELDS = ("rank", "kind", "hospital_id", "km", "plan")


def minutes(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


def dispatch(state: dict, at: int, event: dict | None) -> list[tuple]:
    """One step of an alert. ``plan`` of its first event lists the hospitals of each round; a release
    takes up the rounds where they stopped."""
    if event is None:
        return next_round(state, at)
    kind, hospital = event["kind"], event.get("hospital_id")
    if kind == "created":
        if "status" in state:
            return []
        state.update(status="new", round=0, plan=event.get("plan") or [], answers={}, by=None)
        return next_round(state, at)
    if "status" not in state:
        return [row(at, "rejected", state, hospital, f"{kind}: no such alert")]
    step = {"accept": accept, "decline": decline, "release": release, "location": moved, "cancel": cancel}.get(kind)
    return step(state, at, hospital, event) if step else forward(state, at, hospital, kind)


def row(at: int, kind: str, state: dict, hospital=None, detail: str = "") -> tuple:
    return at, kind, state.get("round", 0), hospital, detail


def next_round(state: dict, at: int) -> list[tuple]:
    """Who didn't answer has missed it; then the next round, or the end."""
    out = [row(at, "missed", state, int(h)) for h, x in state["answers"].items() if x == "pending"]
    state["answers"] = {h: "missed" if x == "pending" else x for h, x in state["answers"].items()}
    if state["round"] >= ROUNDS:
        return [*out, row(at, "exhausted", state, None, NO_ANSWER)]
    picks = state["plan"][state["round"]] if state["round"] < len(state["plan"]) else []
    if not picks:
        return [*out, row(at, "exhausted", state, None, NONE_LEFT)]
    state["round"] += 1
    state["answers"].update({str(h): "pending" for h in picks})
    state["deadline"] = at + ROUND_MS
    return out + [row(at, "notified", state, h) for h in picks]


def accept(state, at, hospital, event) -> list[tuple]:
    if state["status"] != "new":
        return [] if state["by"] == hospital else [row(at, "rejected", state, hospital, f"accept: {state['status']}")]
    missed = [row(at, "missed", state, int(h)) for h, x in state["answers"].items() if x == "pending" and int(h) != hospital]
    state["answers"] = {h: "missed" if x == "pending" else x for h, x in state["answers"].items()} | {str(hospital): "accepted"}
    state.update(status="accepted", by=hospital, deadline=None)
    return [row(at, "accepted", state, hospital), *missed]


def decline(state, at, hospital, event) -> list[tuple]:
    if state["status"] != "new":
        return [row(at, "rejected", state, hospital, f"decline: {state['status']}")]
    state["answers"][str(hospital)] = "declined"
    if "pending" not in state["answers"].values():
        state["deadline"] = at  # no one is left to wait for
    return [row(at, "declined", state, hospital)]


def release(state, at, hospital, event) -> list[tuple]:
    if state["status"] not in ("accepted", "dispatched") or state["by"] != hospital:
        return [row(at, "rejected", state, hospital, f"release: {state['status']}")]
    state["answers"][str(hospital)] = "declined"
    state.update(status="new", by=None, deadline=at, eta=None)
    return [row(at, "released", state, hospital)]


def cancel(state, at, hospital, event) -> list[tuple]:
    if state["status"] not in ("new", "accepted", "dispatched"):
        return [row(at, "rejected", state, hospital, f"cancel: {state['status']}")]
    state.update(status="cancelled", deadline=None, over=True)
    return [row(at, "cancelled", state)]


def forward(state, at, hospital, kind) -> list[tuple]:
    """Stages go forward only, by the hospital that accepted."""
    now = STAGES.index(state["status"]) if state["status"] in STAGES else -1
    if kind not in STAGES[1:] or now < 0 or STAGES.index(kind) <= now or state["by"] != hospital:
        return [row(at, "rejected", state, hospital, f"{kind}: {state['status']}")]
    state.update(status=kind, over=kind == "closed")
    return [row(at, kind, state, hospital)]


def moved(state, at, hospital, event) -> list[tuple]:
    """A position of the ambulance, ``km`` from the scene: the first one dispatches."""
    if state["status"] not in STAGES[:4] or state["by"] != hospital:
        return [row(at, "rejected", state, hospital, f"location: {state['status']}")]
    out = []
    if state["status"] == "accepted":
        state["status"] = "dispatched"
        out.append(row(at, "dispatched", state, hospital, "by position"))
    last, km = state.get("eta"), event["km"]
    if last is None or at - last["at"] >= REFRESH_MS:
        eta = minutes(km * 1.35 / 24 * 60)
        state["eta"] = {"at": at, "eta": eta, "km": km}
        return [*out, row(at, "eta", state, hospital, f"{eta} routed")]
    share = min(MOST_GROWTH, km / last["km"]) if last["km"] > 0 else 1.0
    return [*out, row(at, "eta", state, hospital, f"{minutes(last['eta'] * share)} scaled")]
