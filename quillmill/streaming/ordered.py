"""Keyed state machines over streams, in the order of event time.

Messages wait in their key's state until the watermark has passed them, and only then take effect, by time and number; so what
comes out doesn't depend on how a stream is cut into micro-batches, and equals the batch form of the same rule. A state also
names the next time at which something is due without a message (a window that closes, a task that is forgotten): that is an
event-time timer. What waits is bounded by the delay of the watermark.
"""

from __future__ import annotations

import bisect
import json
import pickle
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: State rows that the keys of a stream share; a stream keeps this number for as long as its checkpoint lives.
BUCKETS = 1024
#: Rows that a bucket hands on at a time.
ROWS_AT_ONCE = 1 << 16


class Rule(Protocol):
    """What a key does with its messages. States are of what JSON knows."""

    #: DDL of what comes out, without the key.
    schema: str

    def take(self, state: dict, at: int, message: dict) -> Iterator[tuple]:
        """Changes the state by a message; what comes out."""

    def due(self, state: dict) -> int | None:
        """The next time at which ``expire`` has something to do, if no message comes before."""

    def expire(self, state: dict) -> Iterator[tuple]:
        """What happens at that time."""


def in_order(messages: DataFrame, key: str, rule: Rule, delay: str) -> DataFrame:
    """(key, what the rule gives): the rule over each key's messages.

    ``messages`` is a stream with ts (timestamp), seq (long, orders messages of equal time) and what the rule reads. Messages
    later than ``delay`` after what was seen are dropped by the watermark. A null key is left out.

    Keys are dealt to BUCKETS by hash, and the keys of a bucket share a state row and a call, as a call for each key costs more
    than its messages do. Waiting messages stay JSON texts until they are due.
    """
    names = [c for c in messages.columns if c not in (key, "ts", "seq")]
    kind = dict(messages.dtypes)[key]
    columns = [key, *[part.split()[0] for part in rule.schema.split(", ")]]
    rows = messages.where(F.col(key).isNotNull()).withWatermark("ts", delay)
    values = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    rows = rows.select(bucket.alias("_bucket"), F.col(key).alias("_key"), "ts", F.unix_millis("ts").alias("_at"), F.col("seq").alias("_seq"), values.alias("_values"))

    def settle(now: int, waiting: list, state: dict) -> Iterator[tuple]:
        """Everything of a key that is due up to the watermark, in order; it leaves ``waiting``."""
        waiting.sort(key=lambda m: m[:2])
        ready = bisect.bisect_right(waiting, now, key=lambda m: m[0])
        for at, _, text in waiting[:ready]:
            while (due := rule.due(state)) is not None and due < at:
                yield from rule.expire(state)
            yield from rule.take(state, at, json.loads(text))
        del waiting[:ready]
        while (due := rule.due(state)) is not None and due < now:
            yield from rule.expire(state)

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(held.get[0]) if held.exists else {}
        if not held.hasTimedOut:
            for batch in batches:
                for of, at, seq, text in zip(*(batch[c].tolist() for c in ("_key", "_at", "_seq", "_values")), strict=True):
                    own.setdefault(of, ([], {}))[0].append((int(at), int(seq), text))
        now, out, times = held.getCurrentWatermarkMs(), [], []
        for of, (waiting, state) in list(own.items()):
            out.extend((of, *row) for row in settle(now, waiting, state))
            due = [t for t in (rule.due(state), waiting[0][0] if waiting else None) if t is not None]
            if due:
                times.append(min(due))
            else:
                del own[of]
        if own:
            held.update((pickle.dumps(own),))
            held.setTimeoutTimestamp(max(min(times) + 1, now + 1))
        elif held.exists:
            held.remove()
        for at in range(0, len(out), ROWS_AT_ONCE):
            yield pd.DataFrame(out[at : at + ROWS_AT_ONCE], columns=columns)

    return rows.groupBy("_bucket").applyInPandasWithState(run, f"{key} {kind}, {rule.schema}", "own binary", "append", GroupStateTimeout.EventTimeTimeout)


class Throttle:
    """The first message opens a window, those inside it are absorbed; it fires at its end."""

    schema = "opened long, fires long, absorbed long"

    def __init__(self, window: int) -> None:
        self.window = window

    def take(self, state: dict, at: int, message: dict) -> Iterator[tuple]:
        if "opened" in state:
            state["absorbed"] += 1
        else:
            state.update(opened=at, absorbed=0)
        return iter(())

    def due(self, state: dict) -> int | None:
        return state["opened"] + self.window if "opened" in state else None

    def expire(self, state: dict) -> Iterator[tuple]:
        opened, absorbed = state.pop("opened"), state.pop("absorbed")
        yield opened, opened + self.window, absorbed


class Lifecycle:
    """A tab's tasks by messages start, step, pause, resume, cancel, done and fail; see ``operators.tasks.lifecycle``."""

    schema = "task long, started long, ended long, outcome string, steps long, paused_ms long"
    ends = {"cancel": "cancelled", "done": "success", "fail": "failed"}  # noqa: RUF012

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def _end(self, state: dict, at: int, outcome: str) -> tuple:
        paused = state["paused_ms"] + (at - state["paused_from"] if state["status"] == "paused" else 0)
        out = state["task"], state["started"], at, outcome, state["steps"], paused
        state.clear()
        return out

    def take(self, state: dict, at: int, message: dict) -> Iterator[tuple]:
        kind, task = message["kind"], message["task"]
        if kind == "start":
            if state:
                yield self._end(state, at, "cancelled")
            state.update(task=task, status="running", started=at, last=at, paused_from=0, paused_ms=0, steps=0)
            return
        if not state or task != state["task"]:
            return
        state["last"] = at
        if kind in self.ends:
            yield self._end(state, at, self.ends[kind])
        elif kind == "pause" and state["status"] == "running":
            state["status"] = "pause_requested"
        elif kind == "resume":
            if state["status"] == "paused":
                state["paused_ms"] += at - state["paused_from"]
            state["status"] = "running"
        elif kind == "step" and state["status"] == "running":
            state["steps"] += 1
        elif kind == "step" and state["status"] == "pause_requested":
            state.update(status="paused", paused_from=at)

    def due(self, state: dict) -> int | None:
        return state["last"] + self.ttl if state else None

    def expire(self, state: dict) -> Iterator[tuple]:
        yield self._end(state, state["last"] + self.ttl, "expired")


class TaskState:
    """What a tab shows of its task, after each message that changes it; see ``task_states``."""

    schema = "task long, status string, done long, total long, message long"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def take(self, state: dict, at: int, message: dict) -> Iterator[tuple]:
        if message["kind"] == "init":
            state.update(task=message["task"], status="processing", done=0, total=0)
        elif not state or state["task"] != message["task"]:
            return
        elif message["kind"] == "clear":
            state.clear()
            return
        elif message["kind"] == "progress":
            state["status"] = "processing"
        else:
            state["status"] = message["kind"]
        for name in ("done", "total"):
            if message["kind"] in ("progress", "paused") and message[name] is not None:
                state[name] = message[name]
        state["last"] = at
        yield state["task"], state["status"], state["done"], state["total"], message["message"]

    def due(self, state: dict) -> int | None:
        return state["last"] + self.ttl if state else None

    def expire(self, state: dict) -> Iterator[tuple]:
        state.clear()
        return iter(())


def task_states(messages: DataFrame, ttl: int, delay: str) -> DataFrame:
    """(tab, task, status, done, total, message): a tab's task after each message that counts.

    ``messages``: tab, task, kind, done, total, message (its number), ts and seq. init starts a task and drops the tab's one
    before; progress and paused bring numbers (null: as before) and, like success, failed and cancelled, count only for the
    tab's task; clear forgets it, and so does ``ttl`` ms of event time without a message. Progress makes it processing again.
    """
    return in_order(messages, "tab", TaskState(ttl), delay)


def throttle_stream(events: DataFrame, key: str, window: int, delay: str) -> DataFrame:
    """(key, opened, fires, absorbed) of a stream with ts and seq, as ``operators.sequences.throttle`` of the same rows; ms."""
    return in_order(events, key, Throttle(window), delay)


def lifecycle_stream(messages: DataFrame, ttl: int, delay: str) -> DataFrame:
    """What ``operators.tasks.lifecycle`` gives, of a stream with tab, task, kind, ts and seq: each task as it ends."""
    return in_order(messages, "tab", Lifecycle(ttl), delay)
