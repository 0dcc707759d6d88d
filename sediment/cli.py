"""Text commands over an engine.

PUT key value... | GET key | DELETE key | PREFIX_SCAN prefix page size | RANGE_SCAN low high page size |
PREFIX_ITERATE prefix | RANGE_ITERATE low high | STATS | HELP | CLEAR | EXIT; verbs in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from .engine import Engine, RateLimited
from .operators.cursor import Cursor

# The short forms of verbs.
ALIASES = {"DEL": "DELETE", "H": "HELP", "QUIT": "EXIT", "Q": "EXIT", "CLS": "CLEAR"}
USAGE = {
    "PUT": "PUT <key> <value>", "GET": "GET <key>", "DELETE": "DELETE <key>", "PREFIX_SCAN": "PREFIX_SCAN <prefix> <page> <size>",
    "RANGE_SCAN": "RANGE_SCAN <low> <high> <page> <size>", "PREFIX_ITERATE": "PREFIX_ITERATE <prefix>", "RANGE_ITERATE": "RANGE_ITERATE <low> <high>",
    "STATS": "STATS", "HELP": "HELP", "CLEAR": "CLEAR", "EXIT": "EXIT",
}
_WORDS = {"PUT": 2, "GET": 1, "DELETE": 1, "PREFIX_SCAN": 3, "RANGE_SCAN": 4, "PREFIX_ITERATE": 1, "RANGE_ITERATE": 2}


class Shell:
    def __init__(self, engine: Engine, user: str = "user"):
        self.engine, self.user = engine, user
        self.cursor: Cursor | None = None
        self.open = True

    def run(self, line: str) -> str:
        """The answer to one line."""
        parts = line.split()
        if not parts:
            return ""
        if self.cursor is not None:
            return self._step(parts[0].lower())
        verb = ALIASES.get(parts[0].upper(), parts[0].upper())
        if verb not in USAGE:
            return f"unknown command {parts[0]}; HELP lists them"
        if len(parts) - 1 < _WORDS.get(verb, 0):
            return f"usage: {USAGE[verb]}"
        do: Callable[..., str] = getattr(self, f"_{verb.lower()}")
        try:
            return do(*parts[1:])
        except (RateLimited, ValueError) as e:
            return f"error: {e}"

    def _put(self, key: str, *words: str) -> str:
        value = " ".join(words)
        if value == self.engine.config.tombstone:  # the in-band mark of a deletion, at this boundary only
            return self._delete(key)
        self.engine.put(self.user, key, value)
        return "OK"

    def _get(self, key: str, *_: str) -> str:
        value = self.engine.get(self.user, key)
        return "not found" if value is None else value

    def _delete(self, key: str, *_: str) -> str:
        self.engine.delete(self.user, key)
        return "OK"

    def _prefix_scan(self, prefix: str, page: str, size: str, *_: str) -> str:
        return self._shown(self.engine.prefix_scan(prefix, int(page), int(size)).collect())

    def _range_scan(self, low: str, high: str, page: str, size: str, *_: str) -> str:
        return self._shown(self.engine.range_scan(low, high, int(page), int(size)).collect())

    def _prefix_iterate(self, prefix: str, *_: str) -> str:
        self.cursor = self.engine.prefix_iterate(self.user, prefix)
        return "next, has_next, reset, stop"

    def _range_iterate(self, low: str, high: str, *_: str) -> str:
        self.cursor = self.engine.range_iterate(self.user, low, high)
        return "next, has_next, reset, stop"

    def _step(self, verb: str) -> str:
        c = self.cursor
        if verb == "next":
            if not c.has_next():
                return "end"
            key, value, _ = c.next()
            return f"{key} {value}"
        if verb == "has_next":
            return str(c.has_next()).lower()
        if verb == "reset":
            c.reset()
            return "OK"
        if verb == "stop":
            c.stop()
            self.cursor = None
            return "OK"
        return "next, has_next, reset, stop"

    @staticmethod
    def _shown(rows: Iterable) -> str:
        return "\n".join(f"{r.key} {r.value}" for r in rows)

    def _stats(self, *_: str) -> str:
        rows = self.engine.stats().orderBy("level").collect()
        return "\n".join(f"level {r.level}: {r.n_runs} runs, {r.n} entries, {r.bytes} bytes, {r.min_key}..{r.max_key}" for r in rows) or "no runs"

    def _help(self, *_: str) -> str:
        return "\n".join(USAGE.values())

    def _clear(self, *_: str) -> str:
        return "\x1b[2J\x1b[H"

    def _exit(self, *_: str) -> str:
        self.engine.close()
        self.open = False
        return "bye"


def main(base: str) -> None:
    from pyspark.sql import SparkSession

    shell = Shell(Engine(SparkSession.builder.getOrCreate(), base))
    while shell.open:
        try:
            print(shell.run(input("> ")))
        except EOFError:
            shell.run("EXIT")


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
