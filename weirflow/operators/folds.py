"""Folds in which each step depends on the one before: pages, group commits, leases.

A fold streams over one key's rows in order with a few numbers of state; rows are sorted by
Spark (and spilled where large) and reach Python as Arrow batches, so memory doesn't depend on
a key's size. Keys are spread by hash; within a key the work is sequential by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], out: str) -> DataFrame:
    """Adds what ``step`` returns to each row; ``step`` gets the key's state and the row's ``columns``."""
    names = [x.split()[0] for x in out.split(",")]
    kept = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start()
        for b in batches:
            made = []
            for k, *row in zip(b[key], *(b[c] for c in columns), strict=True):
                if k != at:
                    at, state = k, start()
                made.append(step(state, tuple(row)))
            cols = list(zip(*made, strict=True)) if made else [[] for _ in names]
            yield pd.concat([b[kept].reset_index(drop=True), pd.DataFrame(dict(zip(names, cols, strict=True)))], axis=1)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def paginate(frames: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """The page of each frame when a log is read from the start; a page's budget starts anew with it.

    A frame larger than the byte budget can't be read past; it and all later ones get page null.
    """

    def step(s: dict, row: tuple) -> tuple:
        n = int(row[0])
        if s["stuck"] or n > max_bytes:
            s["stuck"] = True
            return (None,)
        if s["n"] == 0 or s["n"] + 1 > max_events or s["bytes"] + n > max_bytes:
            s["page"], s["n"], s["bytes"] = s["page"] + 1, 0, 0
        s["n"], s["bytes"] = s["n"] + 1, s["bytes"] + n
        return (s["page"],)

    return fold(frames, "log", ["seq"], ["n_bytes"], lambda: {"page": 0, "n": 0, "bytes": 0, "stuck": False}, step, "page long")


def group_commits(submissions: DataFrame, window_us: int, max_events: int, key: str = "log") -> DataFrame:
    """The batch of each submission (at_us, n). A batch opens with its first submission and
    closes ``window_us`` later, or once it holds ``max_events``; that is looked at before the
    next is taken, so the last submission may overshoot. Commits take no time."""

    def step(s: dict, row: tuple) -> tuple:
        at, n = int(row[0]), int(row[1])
        if s["batch"] == 0 or at >= s["opened"] + window_us or s["n"] >= max_events:
            s["batch"], s["opened"], s["n"] = s["batch"] + 1, at, 0
        s["n"] += n
        return (s["batch"],)

    return fold(submissions, key, ["at_us", "event_id"], ["at_us", "n"], lambda: {"batch": 0, "opened": 0, "n": 0}, step, "batch long")


def lease_machine(ops: DataFrame, ttl_us: int, key: str = "ref") -> DataFrame:
    """What becomes of each operation (op, writer, at_us) on its ref, with generation and epoch after it.

    claim: refused while another holds a live lease, else the epoch rises, also for the holder.
    steal: always succeeds. renew: needs a lease and the last epoch, keeps the generation, and
    revives an expired lease. release: by the holder only. set: refused while any lease is live.
    """

    def step(s: dict, row: tuple) -> tuple:
        op, writer, at = row[0], int(row[1]), int(row[2])
        live = s["holder"] is not None and s["until"] > at
        status = "ok"
        if op == "claim":
            if live and s["holder"] != writer:
                status = "lease_held"
            else:
                s.update(epoch=s["epoch"] + 1, generation=s["generation"] + 1, holder=writer, until=at + ttl_us)
        elif op == "steal":
            s.update(epoch=s["epoch"] + 1, generation=s["generation"] + 1, holder=writer, until=at + ttl_us)
        elif op == "renew":
            if s["holder"] is None:
                status = "no_lease"
            else:
                s["until"] = at + ttl_us
        elif op == "release":
            if s["holder"] is None:
                status = "no_lease"
            elif s["holder"] != writer:
                status = "rejected"
            else:
                s.update(holder=None, until=0, generation=s["generation"] + 1)
        elif live:
            status = "lease_held"
        else:
            s["generation"] += 1
        return status, s["generation"], s["epoch"]

    start = lambda: {"epoch": 0, "generation": 0, "holder": None, "until": 0}
    return fold(ops, key, ["at_us", "event_id"], ["op", "writer", "at_us"], start, step, "status string, generation long, epoch long")
