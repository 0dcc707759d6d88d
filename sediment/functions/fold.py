"""Ordered folds: where each row's result depends on all rows before it in its group."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, by: str, order: str, columns: list[str], start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]], results: str) -> DataFrame:
    """``by, order`` and ``results`` (a DDL of the results' columns), a row per row.

    ``step(state, *values of columns)`` gives the next state and the row's results. A built-in fold would copy its results
    so far for every row; here a group costs time and memory in proportion to its rows. A group is one task's.
    """
    kept = rows.select(by, order, *[c for c in columns if c not in (by, order)])
    fields = [kept.schema[by], kept.schema[order], *StructType.fromDDL(results).fields]
    schema = StructType(fields)

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(order, "ascending")]))
        state, out = start(), []
        for values in zip(*[group.column(c).to_pylist() for c in columns]):
            state, result = step(state, *values)
            out.append(result)
        arrow = to_arrow_schema(schema)
        made = [pa.array(x, f.type) for x, f in zip(zip(*out), list(arrow)[2:])]
        return pa.Table.from_arrays([group.column(by), group.column(order), *made], names=[f.name for f in fields])

    return kept.groupBy(by).applyInArrow(run, schema)
