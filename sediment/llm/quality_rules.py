"""Quality rules: a table of thresholds compiled into one projection without user functions.

Measures of a text (null: empty), all from built-in expressions:

``n_words, word_chars``   words ``[^\\x20\\x09-\\x0D]+`` and the code points in them
``n_symbols``             characters of ``[#*$%&|<>]``
``n_lines, n_dup_lines``  ``\\n``-split lines with a word; those equal to an earlier one
``n_repeat_words``        words inside an 8-word window that occurs twice or more, first included
``n_stop, n_upper``       stop words of the supported languages; ASCII capitals

A row is rejected by the base rule (under 20 words, or over 30 % repeated words) or by any rule of
``RULES``. An empty text has no words, so it fails the base rule and every ratio of it is 0.
Eight-word windows are compared by 64-bit hashes inside one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]+"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as at by from or an be this are "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que qui dans pour est par sur au pas avec "
    "el los las y del se por con no su para al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """``part / whole`` must lie in [least, most]; a whole of 0 gives the ratio 0."""

    name: str
    part: str
    whole: str
    least: float | None = None
    most: float | None = None

    def ratio(self) -> Column:
        return F.when(F.col(self.whole) > 0, F.col(self.part) / F.col(self.whole)).otherwise(F.lit(0.0))

    def holds(self) -> Column:
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (F.col(self.name) >= F.lit(self.least))
        if self.most is not None:
            ok = ok & (F.col(self.name) <= F.lit(self.most))
        return ok


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.25),
    Rule("stop_ratio", "n_stop", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.6),
    Rule("upper_ratio", "n_upper", "word_chars", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_upper")


def _length_of(text: Column, keep_not: str) -> Column:
    return F.length(F.regexp_replace(text, keep_not, "")).cast("long")


def _window_hash(words: str, i: Column) -> Column:
    return F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``."""
    body = text_of(f"`{text}`").alias("__text")
    docs = docs.drop(*[c for c in MEASURES if c != text])
    n = F.size("__words")
    # Under names of their places, no column of docs can clash with one in here.
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], body)
    d = d.withColumn("__words", words_of(F.col("__text")))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn(
        "__hash",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: _window_hash("__words", i))),
    )
    # Only a text with an equal pair of windows pays for the sort that finds where they are.
    d = d.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__hash")) < F.size("__hash"),
            F.sort_array(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(F.col("__sorted"), k - 1)["h"], F.get(F.col("__sorted"), k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    d = d.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", twice), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    d = d.select(
        *[F.col(f"c{i}") for i in range(len(docs.columns))],
        n.cast("long").alias("n_words"),
        _length_of(F.col("__text"), SPACE).alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        _length_of(F.col("__text"), "[^A-Z]+").alias("n_upper"),
    )
    return d.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *MEASURES)


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measures, one ratio a rule, ``base_failed`` and ``kept``: one projection."""
    d = measured(docs.drop("base_failed", "kept", *[r.name for r in rules]), text)
    d = d.select("*", *[r.ratio().alias(r.name) for r in rules])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = F.lit(True)
    for r in rules:
        verdict = verdict & r.holds()
    return d.select("*", base.alias("base_failed"), (~base & verdict).alias("kept"))


def filtered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that every rule keeps, with the columns of ``docs``.

    A plain filter would be pushed below the measures, with every expression it names written out again and
    again; exploding a row into itself or into nothing leaves them computed once.
    """
    names = docs.columns
    clear = docs.select(*[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(names)], F.col(text).alias("__body"))
    row = F.struct(*[F.col(f"__in{i}") for i in range(len(names))])
    kept = judged(clear, "__body", rules).select(F.explode(F.when(F.col("kept"), F.array(row))).alias("r"))
    return kept.select(*[F.col(f"r.__in{i}").alias(c) for i, c in enumerate(names)])


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[r.name for r in RULES],
    )


def _ratio_sql(r: Rule) -> str:
    return f"CASE WHEN {r.whole} > 0 THEN {r.part}::DOUBLE / {r.whole} ELSE 0.0 END AS {r.name}"


def _holds_sql(r: Rule) -> str:
    said = [f"{r.name} >= {r.least}"] * (r.least is not None) + [f"{r.name} <= {r.most}"] * (r.most is not None)
    return " AND ".join(said)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(0, len(ws) - {WINDOW - 1})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: list_contains({STOP_WORDS!r}, lower(x))))::BIGINT AS n_stop,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
q AS (SELECT *, {", ".join(map(_ratio_sql, RULES))},
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(map(_holds_sql, RULES))}) AS kept, {", ".join(r.name for r in RULES)}
FROM q
"""
