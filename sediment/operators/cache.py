"""A least-recently-used cache over a log of accesses."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame

from ..functions.fold import ordered_fold


def lru_replay(accesses: DataFrame, capacity: int) -> DataFrame:
    """``user, seq, hit`` for rows ``user, seq, key``: whether the key was among the user's ``capacity`` last used ones."""

    def step(held: OrderedDict, key: str) -> tuple:
        hit = key in held
        held[key] = None
        held.move_to_end(key)
        if len(held) > capacity:
            held.popitem(last=False)
        return held, (hit,)

    return ordered_fold(accesses, "user", "seq", ["key"], OrderedDict, step, "hit boolean")
