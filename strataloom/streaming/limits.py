"""Sliding-window request limits: refused requests don't count, so plain windows can't tell."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user long, id long, ts timestamp, allowed boolean"


def admit(times: list[float], taken: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which requests pass, and the times that still count; one exactly ``seconds`` old doesn't."""
    out, taken = [], list(taken)
    for t in times:
        while taken and t - taken[0] >= seconds:
            taken.pop(0)
        ok = len(taken) < most
        if ok:
            taken.append(t)
        out.append(ok)
    return out, taken


def _answer(user, rows: pd.DataFrame, allowed: list[bool]) -> pd.DataFrame:
    return pd.DataFrame({"user": user, "id": rows["id"].to_numpy(), "ts": rows["ts"].to_numpy(), "allowed": allowed})


def _seconds(rows: pd.DataFrame) -> list[float]:
    return [t.timestamp() for t in rows["ts"]]


def limited(requests: DataFrame, most: int = 20, seconds: float = 60.0) -> DataFrame:
    """Requests (user, id, ts) with ``allowed``; a fold over each user's requests in time order.

    Requests are dealt out and sorted by Spark and folded as they stream by; only the times that
    still count are held, however many requests a user has.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, taken = None, []
        for batch in batches:
            allowed = []
            for now, rows in batch.groupby("user", sort=False):
                if now != user:
                    user, taken = now, []
                own, taken = admit(_seconds(rows), taken, most, seconds)
                allowed += own
            yield _answer(batch["user"].to_numpy(), batch, allowed)

    rows = requests.where("user is not null").select(F.col("user").cast("long").alias("user"), "id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("user").sortWithinPartitions("user", "ts", "id").mapInPandas(fold, OUT)


def limited_stream(requests: DataFrame, most: int = 20, seconds: float = 60.0) -> DataFrame:
    """The same over a stream: at most ``most`` times are state, which goes when it is out of date."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        group = pd.concat(list(batches)).sort_values(["ts", "id"])
        taken = list(state.get[0]) if state.exists else []
        allowed, taken = admit(_seconds(group), taken, most, seconds)
        state.update((taken,))
        state.setTimeoutDuration(int(seconds * 1000))
        yield _answer(int(key[0]), group, allowed)

    rows = requests.select("user", "id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user").applyInPandasWithState(step, OUT, "taken array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
