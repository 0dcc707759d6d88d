"""Token buckets per user: replay of a log of requests, and the online check."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import ordered_fold


def admit(tokens: int, t0: int, now: int, capacity: int, rate: float, strict: bool) -> tuple[tuple[int, int], tuple[bool, int]]:
    """One request at time ``now`` to a bucket: ((tokens, t0) after it, (admitted, tokens))."""
    added = math.floor((now - t0) * rate)
    filled = min(tokens + added, capacity)
    if strict and added > 0:
        t0 = now
    ok = filled >= 1
    tokens = filled - 1 if ok else (filled if strict else tokens)
    return (tokens, t0), (ok, tokens)


def replay(requests: DataFrame, capacity: int, rate: float, strict: bool = False) -> DataFrame:
    """``user, seq, allowed, tokens`` for rows ``user, seq, ts`` (seconds), in order of seq.

    A bucket opens full at its user's first request. With each request floor((ts - t0) * rate) tokens are added, up to
    the capacity; under one token it is refused and the bucket stays as it was. t0 is the opening time throughout,
    or, if strict, the last time that tokens were added.

    Which requests pass depends on all before: it is an ordered fold over one user's requests.
    """
    def step(state: tuple | None, ts: int) -> tuple:
        tokens, t0 = state or (capacity, ts)
        return admit(tokens, t0, ts, capacity, rate, strict)

    asked = requests.select("user", "seq", F.col("ts").cast("long").alias("ts"))
    return ordered_fold(asked, "user", "seq", ["ts"], lambda: None, step, "allowed boolean, tokens long")


class Limiter:
    """The online check of one process: a bucket per user, opened full on first use."""

    def __init__(self, capacity: int = 1000, rate: float = 0.1, clock=time.time, strict: bool = False):
        self.capacity, self.rate, self.clock, self.strict = capacity, rate, clock, strict
        self.buckets: dict[str, tuple[int, int]] = {}

    def allows(self, user: str) -> bool:
        now = int(self.clock())
        tokens, t0 = self.buckets.get(user, (self.capacity, now))
        self.buckets[user], (ok, _) = admit(tokens, t0, now, self.capacity, self.rate, self.strict)
        return ok
