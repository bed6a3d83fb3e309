"""The choice between two models: provisional without a labelled set, closed with the paired comparison of their F1."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from corpuslens.operators.comparison import Difference
from corpuslens.plans.selection import Candidate, Decision, beats, decide

Check = Callable[[Candidate], tuple[str, ...]]


@dataclass(frozen=True)
class Step:
    """What the comparison of F1 says: first, second, tie or undefined; and why."""

    outcome: str
    reason: str


def f1_step(d: Difference) -> Step:
    """The side that the interval names, if the difference observed is on it; else the step is undefined."""
    if d.low is None or d.high is None or d.verdict is None:
        return Step("undefined", f"the difference has no interval ({d.undefined} undefined resamples)")
    where = f"[{d.low:.4f}, {d.high:.4f}]"
    if d.verdict == "tie":
        return Step("tie", f"the interval {where} holds or touches 0")
    side = "first" if d.verdict == "first_higher" else "second"
    agrees = d.value is not None and (d.value > 0 if side == "first" else d.value < 0)
    if not agrees:
        return Step("undefined", f"the interval {where} names the {side} side, the observed difference doesn't")
    return Step(side, f"the interval {where} lies on the {side} side of 0")


def provisional(first: Candidate, second: Candidate, check: Check, fallback: str) -> Decision:
    """Gates, coherence, fallback: the labelled set is still to come."""
    _distinct(first, second, fallback)
    d = decide(first, second, check, [("npmi", True)], fallback)
    return replace(d, reasons=("provisional: without the F1 of a labelled set", *d.reasons))


@dataclass(frozen=True)
class Closed:
    """The provisional choice, the step of F1, the decision (None if the rule doesn't decide, with the reason), and what another coherence gives."""

    provisional: Decision
    step: Step
    decision: Decision | None
    undefined_reason: str | None
    sensitivity: str
    flipped: bool


def close(first: Candidate, second: Candidate, difference: Difference, check: Check, fallback: str) -> Closed:
    """Gates, then F1, then coherence, then the fallback; ``npmi_sensitivity`` in the means is the coherence of the sensitivity."""
    early = provisional(first, second, check, fallback)
    step = f1_step(difference)
    decision = _closed(first, second, step, check, fallback)
    other = _closed(*(replace(c, mean=c.mean | {"npmi": c.mean.get("npmi_sensitivity")}) for c in (first, second)), step, check, fallback)
    name = lambda d: "undefined" if d is None else str(d.winner)
    return Closed(early, step, decision, None if decision is not None else step.reason, name(other), name(decision) != name(other))


def _closed(first: Candidate, second: Candidate, step: Step, check: Check, fallback: str) -> Decision | None:
    failed = {c.name: check(c) for c in (first, second)}
    passed = [c for c in (first, second) if not failed[c.name]]
    if len(passed) < 2:
        return decide(first, second, check, [], fallback)
    if step.outcome == "undefined":
        return None
    if step.outcome in ("first", "second"):
        return Decision((first if step.outcome == "first" else second).name, "f1", (step.reason,))
    for a, b in ((first, second), (second, first)):
        if beats(a, b, "npmi"):
            return Decision(a.name, "npmi", (step.reason,))
    return Decision(fallback, "fallback", (step.reason, "npmi doesn't tell them apart"))


def _distinct(first: Candidate, second: Candidate, fallback: str) -> None:
    if first.name == second.name or fallback not in (first.name, second.name):
        raise ValueError("two models are wanted, one of which is the fallback")


def to_record(c: Candidate) -> str:
    return json.dumps(asdict(c), sort_keys=True)


def from_record(record: str) -> Candidate:
    """A saved candidate, with no key too many or too few and numbers or nothing as values."""
    got = json.loads(record)
    if not isinstance(got, dict) or set(got) != {"name", "mean", "sd"} or not isinstance(got["name"], str):
        raise ValueError("a candidate has a name, means and deviations")
    for part in ("mean", "sd"):
        if not isinstance(got[part], dict) or any(v is not None and (isinstance(v, bool) or not isinstance(v, int | float)) for v in got[part].values()):
            raise ValueError(f"the {part} of a candidate are numbers or nothing")
    return Candidate(**got)
