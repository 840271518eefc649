"""The crawl queue and the circuit breaker as state over a stream of events.

Events: run_id, url_id, event (enqueue, claim, done, fail, reset), at, and what the queue keeps.  The state of
an address is tiny, so its store grows with the addresses alone; events may be delivered more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

QUEUE = "run_id string, url_id long, status string, retry_count int, reset_count int, retry_at long, updated_at long"
STATE = "status string, retry_count int, reset_count int, retry_at long, updated_at long"
BREAKER = "host string, state string, failures int, opened_at long"
DELAY, LONGEST, TRIES = 60, 3600, 5
THRESHOLD, COOL_DOWN = 5, 300


def step(state: tuple | None, event: str, at: int) -> tuple:
    """The next (status, retry_count, reset_count, retry_at, updated_at): queued, pending, done or failed.

    An address is queued once, whatever is enqueued again; claims need a queued and due one; a failure doubles the
    wait until the tries are used up; done is final; a reset queues what is pending.
    """
    if state is None:
        return ("queued", 0, 0, 0, at) if event == "enqueue" else ("done", 0, 0, 0, at) if event == "done" else ("queued", 0, 0, 0, at)
    status, retries, resets, retry_at, last = state
    if at < last or status == "done":
        return state
    if event == "claim" and status == "queued" and retry_at <= at:
        return ("pending", retries, resets, retry_at, at)
    if event == "done":
        return ("done", 0, resets, 0, at)
    if event == "fail" and status == "pending":
        if retries + 1 >= TRIES:
            return ("failed", retries + 1, resets, 0, at)
        return ("queued", retries + 1, resets, at + min(LONGEST, DELAY * 2**retries), at)
    if event == "reset" and status == "pending":
        return ("queued", retries, resets + 1, retry_at, at)
    return state


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("at", kind="stable")


def _queue(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else None
    for e, t in _in_order(batches)[["event", "at"]].itertuples(index=False):
        now = step(now, e, int(t))
    state.update(now)
    yield pd.DataFrame([(*key, *now)], columns=[x.split()[0] for x in QUEUE.split(", ")])


def queue_states(events: DataFrame) -> DataFrame:
    """State of each address touched in a micro-batch, after it; update mode.  events: run_id, url_id, event, at (epoch seconds)."""
    return events.select("run_id", "url_id", "event", "at").groupBy("run_id", "url_id").applyInPandasWithState(_queue, QUEUE, STATE, "update", "NoTimeout")


def breaker_step(state: tuple, ok: bool, at: int, threshold: int = THRESHOLD, cool_down: int = COOL_DOWN) -> tuple[str, int, int]:
    """closed -> open after ``threshold`` failures in a row -> half_open after ``cool_down`` -> closed or open again."""
    name, failures, opened = state
    if name == "open" and at - opened >= cool_down:
        name = "half_open"
    if ok:
        return (name, failures, opened) if name == "open" else ("closed", 0, 0)
    failures += 1
    return ("open", failures, opened if name == "open" else at) if name == "half_open" or failures >= threshold else (name, failures, opened)


def _breaker(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else ("closed", 0, 0)
    for ok, t in _in_order(batches)[["ok", "at"]].itertuples(index=False):
        now = breaker_step(now, bool(ok), int(t))
    state.update(now)
    yield pd.DataFrame([(*key, *now)], columns=["host", "state", "failures", "opened_at"])


def breaker_states(outcomes: DataFrame) -> DataFrame:
    """State of each host's breaker after a micro-batch.  outcomes: host, ok, at (epoch seconds)."""
    return outcomes.select("host", "ok", "at").groupBy("host").applyInPandasWithState(_breaker, BREAKER, "state string, failures int, opened_at long", "update", "NoTimeout")


def new_urls(found: DataFrame) -> DataFrame:
    """Each (run_id, url) once: links seen again are no news."""
    return found.dropDuplicates(["run_id", "url"])
