"""Rate limits and series votes on streams: the same steps as the batch folds, one event at a time, with keyed state.

Events of a key must arrive in order of seq across micro-batches; within one they are sorted. A key's events of one micro-batch come
in several parts, in any order, so they are put together first: the size of a micro-batch bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from intervane import config as C


_PART = 100_000


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All events of a key in a micro-batch, by seq."""
    return pd.concat(list(parts), ignore_index=True).sort_values(["seq"], kind="stable")


def admit_next(last: list[int], at: int, permits: int = 25, window_ms: int = 60_000, grace_ms: int = 50) -> tuple[int, list[int]]:
    """(when a request at time at passes, last admissions with it); see history.admit."""
    at = max(at, last[-1]) if last else at
    full = len(last) >= permits
    t = last[0] + window_ms + grace_ms if full and last[0] + window_ms > at else at
    return t, [*last[1 if full else 0 :], t]


def admit(requests: DataFrame, key: str, permits: int = 25, window_ms: int = 60_000, grace_ms: int = 50) -> DataFrame:
    """Streaming history.admit: (key, seq, at_ms, admitted_ms) of requests (key long, seq long, at_ms long). State: at most permits times a key."""

    def run(k, batches, state):
        last = list(state.get[0]) if state.exists else []
        whole = _in_order(batches)
        for i in range(0, len(whole), _PART):
            pdf = whole.iloc[i : i + _PART]
            out = []
            for at in pdf["at_ms"]:
                t, last = admit_next(last, int(at), permits, window_ms, grace_ms)
                out.append(t)
            yield pd.DataFrame({key: k[0], "seq": pdf["seq"].values, "at_ms": pdf["at_ms"].values, "admitted_ms": out})
        state.update((last,))

    return requests.select(key, "seq", "at_ms").groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, at_ms long, admitted_ms long", "last array<long>", "append", GroupStateTimeout.NoTimeout)


def vote_next(state: tuple[str, int, int], outcome: str, group: str | None, entry: int, most: int = C.MAX_CONFIRMATIONS) -> tuple[str, int, int]:
    """(preferred group, entry, votes) after one event; see history.vote."""
    p_group, p_entry, votes = state
    g = (group or "").strip()
    same = g.lower() == p_group.lower()
    if outcome == "success":
        if not g:
            return (p_group, entry, votes) if votes == 0 else state
        if same:
            return p_group, entry, min(votes + 1, most)
        return (g, entry, 1) if votes <= 1 else (p_group, p_entry, votes - 1)
    if outcome == "reject" and g and same:
        return ("", 0, 0) if votes <= 1 else (p_group, p_entry, votes - 1)
    return state


def vote(events: DataFrame, key: str) -> DataFrame:
    """Streaming history.vote: the state of each key after each micro-batch that has events of it. events: (key long, seq, outcome, group, entry_id)."""

    def run(k, batches, state):
        now = state.get if state.exists else ("", 0, 0)
        for r in _in_order(batches).itertuples(index=False):
            now = vote_next(now, r.outcome, r.group, int(r.entry_id))
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "p_group": [now[0]], "p_entry": [now[1]], "votes": [now[2]]})

    return events.select(key, "seq", "outcome", "group", "entry_id").groupBy(key).applyInPandasWithState(run, f"{key} long, p_group string, p_entry long, votes int", "p_group string, p_entry long, votes int", "update", GroupStateTimeout.NoTimeout)


def log_next(log: list[tuple[int, str]], seq: int, status: str, most: int = C.MAX_ATTEMPTS) -> list[tuple[int, str]]:
    """An attempt log after one attempt: an applied one supersedes older ones, the newest most stay."""
    if status == "Applied":
        log = [(s, "Superseded" if x == "Applied" else x) for s, x in log]
    return [*log, (seq, status)][-most:]


def attempts(events: DataFrame, key: str) -> DataFrame:
    """Streaming history.statuses: (key, log) of each key after each micro-batch. events: (key long, seq, status)."""

    def run(k, batches, state):
        log = [(r["seq"], r["status"]) for r in state.get[0]] if state.exists else []
        for r in _in_order(batches).itertuples(index=False):
            log = log_next(log, int(r.seq), r.status)
        rows = [{"seq": s, "status": x} for s, x in log]
        state.update((rows,))
        yield pd.DataFrame({key: [k[0]], "log": [rows]})

    return events.select(key, "seq", "status").groupBy(key).applyInPandasWithState(run, f"{key} long, log array<struct<seq:long,status:string>>", "log array<struct<seq:long,status:string>>", "update", GroupStateTimeout.NoTimeout)
