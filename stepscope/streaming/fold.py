"""The step-by-step fold of a live session: small integers and short buffers only.

It states the same transition rule as the batch fold, on flags that were computed by
Spark expressions before; everything judged from its counters (drift, reflection,
verdict) is again a Spark expression after it.
"""

from __future__ import annotations

import json

LOOK_REPEAT, LOOK_EFFECT, LOOK_FAIL = 5, 3, 4


class Event:
    """One event as `guard.packed` hands it over, with its flags named."""

    __slots__ = (
        "ts", "seq", "kind", "action_name", "args_key", "tool_response", "reasoning",
        "action_key", "step_words", "flags", "plan", "terms",
    )

    def __init__(self, ts, body: str):
        # Fields that are null are left out of the body.
        get = json.loads(body).get
        self.ts, self.seq, self.kind, self.flags = ts, get("seq"), get("kind"), get("flags")
        self.action_name, self.args_key = get("action_name"), get("args_key")
        self.tool_response, self.reasoning = get("tool_response"), get("reasoning")
        self.action_key, self.step_words = get("action_key"), get("step_words")
        self.plan, self.terms = get("plan"), get("terms")

    said_hit = property(lambda self: bool(self.flags & 1))
    heard_hit = property(lambda self: bool(self.flags & 2))
    no_effect = property(lambda self: bool(self.flags & 4))
    response_failed = property(lambda self: bool(self.flags & 8))
    failure_term = property(lambda self: bool(self.flags & 16))
    success_phrase = property(lambda self: bool(self.flags & 32))
    searches = property(lambda self: bool(self.flags & 64))
    acts = property(lambda self: bool(self.flags & 128))
    is_placeholder = property(lambda self: bool(self.flags & 256))
    is_substantive = property(lambda self: bool(self.flags & 512))


def fresh() -> dict:
    return {
        "n": 0, "seq": -1, "matches": 0, "total": 0, "k": 0, "count": 0,
        "completed": 0, "stalled": 0, "failed": 0, "last": None, "last_steps": 0,
        "words": [], "ids": [], "texts": [], "fallback": True,
        "planned": False, "placeholder": True, "closed": False,
        "keys": [], "effects": [], "fails": [], "late": 0, "opposed": [], "required": [],
        "timer": None,
    }


def take_plan(state: dict, row) -> bool:
    """Start tracking a plan: the first one, or the real one after a placeholder."""
    upgrade = state["placeholder"] and row.is_substantive
    if state["planned"] and not upgrade:
        return False
    plan, terms = row.plan, row.terms
    state.update(
        planned=True, placeholder=row.is_placeholder,
        ids=plan["subgoal_ids"], texts=plan["descriptions"],
        words=plan["subgoal_words"], total=len(plan["subgoal_ids"]),
        fallback=plan["is_fallback"],
        opposed=terms["opposed"], required=terms["required"],
        k=0, count=0, completed=0, stalled=0, failed=0, last=None, last_steps=0, matches=0,
    )
    return True


def failed_repeats(state: dict, key: str) -> int:
    return sum(1 for k in state["fails"] if k == key)


def plan_faults(state: dict, row) -> tuple[int | None, int | None]:
    """First contradicted direction and first left-out term of the task in a search, by number."""
    if not row.searches:
        return None, None
    task, plan = state.get("opposed", []), row.terms["opposed"]
    contra = next(
        (m for m in range(len(task)) if task[m] and not task[m ^ 1] and plan[m ^ 1] and not plan[m]), None
    )
    required = state.get("required", [])
    omitted = next((i for i, t in enumerate(required) if row.acts and t and not row.terms["required"][i]), None)
    return contra, omitted


def take_step(state: dict, row, cap: int) -> dict:
    """Fold one finished tool call; returns its counters and the transition, if any."""
    key = row.action_key
    repeats = sum(1 for k in state["keys"] if k == key) if row.action_name else 0
    effects = sum(state["effects"]) if row.no_effect else None
    step = state["n"]
    ended = None
    if state["k"] < state["total"]:
        state["count"] += 1
        ended = _outcome(state, row, cap)
        if ended:
            state[{"completed": "completed", "stalled_advanced": "stalled", "failed": "failed"}[ended]] += 1
            state.update(last=ended, last_steps=state["count"], count=0, k=state["k"] + 1)
    contra, omitted = plan_faults(state, row)
    matched = bool(
        row.said_hit or repeats >= 2 or (effects is not None and effects >= 2) or row.heard_hit
        or contra is not None or omitted is not None
    )
    state["matches"] += matched
    state["n"] += 1
    state["keys"] = (state["keys"] + [key])[-LOOK_REPEAT:]
    state["effects"] = (state["effects"] + [int(bool(row.no_effect))])[-LOOK_EFFECT:]
    state["fails"] = (state["fails"] + [key if row.response_failed else None])[-LOOK_FAIL:]
    return {"step_index": step, "repeats": repeats, "no_effects": effects, "ended": ended,
            "contradicted": contra, "omitted": omitted}


def _outcome(state: dict, row, cap: int) -> str | None:
    if row.failure_term:
        return "failed"
    following = state["k"] + 1
    if following < state["total"]:
        if sum(1 for w in state["words"][following] if w in row.step_words) >= 2:
            return "completed"
    if row.success_phrase:
        return "completed"
    return "stalled_advanced" if state["count"] >= cap else None


def snapshot(state: dict) -> dict:
    """The subgoal state after the last step."""
    total, k = state["total"], state["k"]
    shown = min(k, total - 1)
    over = k >= total
    return {
        "current_subgoal_id": state["ids"][shown] if total else None,
        "status": "not_started" if not total else state["last"] if over else "in_progress",
        "steps_in_current_subgoal": 0 if not total else state["last_steps"] if over else state["count"],
        "completed_subgoals_count": state["completed"],
        "stalled_advanced_subgoals_count": state["stalled"],
        "failed_subgoals_count": state["failed"],
        "total_subgoals_count": total,
        "active_subgoal_index": max(shown, 0),
        "is_fallback": state["fallback"],
    }
