"""State tracking of running trajectories as a stream: the same fold as operators.replay.track, keyed by trajectory.

There is no event time. Turns of a trajectory are applied in order; a turn that comes early waits until those before
it have come (first turn: 1). With `ttl_ms`, a trajectory's state goes when it has been silent for so long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.replay import TRACKED, track

COLUMNS = [c.split()[0] for c in TRACKED.split(", ")]


def folded(saved: dict, rows: list[tuple], rules: list[dict]) -> tuple[dict, list[tuple]]:
    """Apply rows (turn, action, observation) to what is saved of a trajectory. Turns seen before are ignored."""
    waiting = {int(k): v for k, v in saved["waiting"].items()}
    for turn, action, seen in rows:
        if int(turn) >= saved["next"]:
            waiting.setdefault(int(turn), [action, seen])
    out = []
    state, pending, at = saved["state"], saved["pending"], saved["next"]
    while at in waiting:
        action, seen = waiting.pop(at)
        state, pending, rule, issue = track(state, pending, at, rules, json.loads(action), seen)
        out.append((at, "rule" if rule else "model", rule, issue, json.dumps(state, sort_keys=True)))
        at += 1
    return {"state": state, "pending": pending, "next": at, "waiting": waiting}, out


def track_stream(turns: DataFrame, rules: list[dict], initial: str = "{}", ttl_ms: int | None = None) -> DataFrame:
    """turns: a stream of (trajectory_id, turn, action JSON, observation)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved = json.loads(state.get[0]) if state.exists else {"state": json.loads(initial), "pending": [], "next": 1, "waiting": {}}
        new = [r for pdf in batches for r in pdf[["turn", "action", "observation"]].itertuples(index=False, name=None)]
        saved, out = folded(saved, new, rules)
        state.update((json.dumps(saved),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=COLUMNS)

    slim = turns.select("trajectory_id", "turn", "action", "observation")
    return slim.groupBy("trajectory_id").applyInPandasWithState(update, TRACKED, "saved string", "append", "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")
