"""The job state machine and concurrency slots as stateful streams.

A message asks to claim, beat or finish a job. A pending job, or a running one whose lease is over, is
claimed; a job that has ended stays ended. The state is one small row per job; time comes with the messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_SECONDS = 300
ENDED = ("completed", "failed", "partial")
OUTPUT = "job_id string, message_id long, outcome string, status string"
STATE = "status string, lease double"


def step(status: str, lease: float, action: str, at: float, seconds: float = LEASE_SECONDS) -> tuple[str, str, float]:
    """(outcome, status, lease end) after a message."""
    if action == "create":
        return ("exists", status, lease) if status else ("created", "pending", 0.0)
    if not status:
        return "not_found", "", 0.0
    if status in ENDED:
        return "terminal", status, lease
    if action == "claim":
        return ("in_flight", status, lease) if status == "processing" and at < lease else ("claimed", "processing", at + seconds)
    if action == "beat":
        return ("beat", status, at + seconds) if status == "processing" else ("ignored", status, lease)
    if action in ENDED:
        return ("ended", action, lease) if status == "processing" else ("ignored", status, lease)
    return "unknown", status, lease


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, lease = state.get if state.exists else ("", 0.0)
    rows = pd.concat(list(batches)).sort_values(["at", "message_id"])
    out = []
    for message, action, at in zip(rows["message_id"], rows["action"], rows["at"], strict=True):
        outcome, status, lease = step(status, lease, action, float(at))
        out.append((key[0], int(message), outcome, status))
    if status:
        state.update((status, lease))
    yield pd.DataFrame(out, columns=["job_id", "message_id", "outcome", "status"])


def job_outcomes(messages: DataFrame) -> DataFrame:
    """(job_id, message_id, outcome, status) of a stream of (job_id, message_id, action, at in seconds)."""
    return messages.groupBy("job_id").applyInPandasWithState(_run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def job_outcomes_batch(messages: DataFrame) -> DataFrame:
    """The same over a finished table: each job's messages in order of time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        status, lease, out = "", 0.0, []
        for job, message, action, at in rows.sort_values(["at", "message_id"])[["job_id", "message_id", "action", "at"]].itertuples(index=False):
            outcome, status, lease = step(status, lease, action, float(at))
            out.append((job, int(message), outcome, status))
        return pd.DataFrame(out, columns=["job_id", "message_id", "outcome", "status"])

    return messages.groupBy("job_id").applyInPandas(run, OUTPUT)


SLOT_OUTPUT = "owner long, lease_id string, at double, granted boolean, held long"
SLOT_STATE = "leases map<string,double>"


def slots(requests: DataFrame, limit: int, ttl: float) -> DataFrame:
    """Concurrency slots per owner over a stream of (owner, lease_id, action acquire|release, at): expired leases are
    purged on access, and asking again for a lease that is held renews it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["at", "lease_id"])
        out = []
        for lease, action, at in zip(rows["lease_id"], rows["action"], rows["at"], strict=True):
            held = {k: end for k, end in held.items() if end > at}
            granted = action == "acquire" and (lease in held or len(held) < limit)
            if action == "release":
                held.pop(lease, None)
            elif granted:
                held[lease] = float(at) + ttl
            out.append((int(key[0]), lease, float(at), granted, len(held)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["owner", "lease_id", "at", "granted", "held"])

    return requests.groupBy("owner").applyInPandasWithState(run, SLOT_OUTPUT, SLOT_STATE, "append", GroupStateTimeout.NoTimeout)


def dead_letters(outcomes: DataFrame) -> DataFrame:
    """Messages that can't be served: of no known job or action."""
    return outcomes.where(outcomes["outcome"].isin("not_found", "unknown"))
