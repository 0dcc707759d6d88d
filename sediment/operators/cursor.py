"""A client's cursor over a sorted snapshot: next, has_next, stop and reset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


class Cursor:
    """Rows are fetched by partition, as they are asked for; the snapshot is the plan's.

    ``next`` gives (key, value, more after this) and ("", "", False) once stopped or past the end;
    ``reset`` goes back to the first row and ends a stop.
    """

    def __init__(self, rows: DataFrame):
        self._rows = rows.orderBy("key").select("key", "value")
        self.reset()

    def reset(self) -> None:
        self._stopped = False
        self._source: Iterator = self._rows.toLocalIterator(prefetchPartitions=True)
        self._ahead = next(self._source, None)

    def stop(self) -> None:
        self._stopped = True

    def has_next(self) -> bool:
        return not self._stopped and self._ahead is not None

    def next(self) -> tuple[str, str, bool]:
        if not self.has_next():
            return "", "", False
        row, self._ahead = self._ahead, next(self._source, None)
        return row.key, row.value, self._ahead is not None

    def __iter__(self) -> Iterator[tuple[str, str]]:
        while self.has_next():
            key, value, _ = self.next()
            yield key, value
