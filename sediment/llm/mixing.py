"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources in code-point order (null last) weigh 1, 2, 3,
repeating, and share the sum of all sizes by weight. A target stops at ``MAX_COPIES`` times its
source's size; what is over goes to the others by weight until no target is above its bound.

Inside a source every document expects the same number of copies, target / source size. The
documents stand in a fixed order (size, a hash of the id or, without one, of the text, the id), the expected copies are
prefix-summed, one offset in [0, 1) that depends on the source alone is added, and a document is
emitted once per integer that its step crosses. As neighbours in that order have like sizes, the
words taken stay within about one document of the target.

No source is gathered anywhere: a document's place is the sum of three counts, of the smaller sizes
of its source, of the smaller hash buckets of its size, and of the rows before it in its bucket.
The first two come from pre-aggregated tables, the third from a window over one bucket. Texts are split into words once:
rows are written with their sizes, and both the tables of counts and the window read them back.

Null ids sort by hash and text, rows that are equal throughout are separate rows, empty texts have size 0 and
may be taken (they add nothing), an empty table gives an empty result. A source whose texts are all
empty has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import spread
from .common import count_words, text_of, unit_interval, written

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 17
#: Hash buckets that rows of one source and size are dealt over; the hash is 12 bits of an MD5.
BUCKETS = 4096


def _weight(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, source_size, target``, from rows ``source, source_size``.

    Targets are the level of water poured into vessels as wide as the weights and as high as the
    bounds: the vessels fill in the order of height over width, so one running sum over the table
    of sources finds the level. That table has one row per source, never one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", _weight(F.row_number().over(order)))
    s = s.withColumn("bound", MAX_COPIES * F.col("source_size"))
    fill = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    s = s.withColumn("width", F.sum("weight").over(rest))
    # The first vessel that the even share of what is left doesn't fill sets the level for all after it.
    s = s.withColumn("open", F.col("left") * F.col("weight") < F.col("bound") * F.col("width"))
    s = s.withColumn("level", F.first(F.when(F.col("open"), F.struct("left", "width")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    level = F.col("level")
    return s.select(
        "source",
        "source_size",
        F.when(level.isNull(), F.col("bound").cast("double"))
        .otherwise((F.col("weight") * level["left"]).cast("double") / level["width"].cast("double"))
        .alias("target"),
    )


def _bucket(doc_id: Column, tie: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), tie)), 1, 3), 16, 10).cast("int")


def mixed(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``doc_id, source, size, tie``) plus ``source_size, target, copies``.

    The rows are shuffled once: the key that numbers them is the key that joins the counts before them, with the null
    source written as a value of its own.
    """
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = rows.drop("source_size", "target", "copies").withColumn("__bucket", _bucket(F.col("doc_id"), F.col("tie"))).withColumn("__source", named)
    # One histogram, of which the others are sums: its exchange is reused, so the texts are read for it once.
    by_bucket = rows.groupBy("__source", "size", "__bucket").agg(F.count("*").alias("n"))
    by_size = by_bucket.groupBy("__source", "size").agg(F.sum("n").alias("n"))
    sizes = by_size.groupBy("__source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    source = F.when(F.col("__source") != "n", F.substring("__source", 2, 1 << 30))
    goal = targets(sizes.select(source.alias("source"), "source_size")).withColumn("__source", named)

    def before(*by: str):
        return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)

    in_size = F.coalesce(F.sum("n").over(before("__source", "size", "__bucket")), F.lit(0))
    smaller = F.coalesce(F.sum("n").over(before("__source", "size")), F.lit(0))
    at = by_bucket.select("__source", "size", "__bucket", in_size.alias("in_size"))
    at = at.join(by_size.select("__source", "size", smaller.alias("smaller")), ["__source", "size"])
    at = at.join(goal.drop("source"), "__source").withColumn("__before", F.col("in_size") + F.col("smaller")).drop("in_size", "smaller")

    place = Window.partitionBy("__source", "size", "__bucket").orderBy("doc_id", "tie")
    placed = rows.withColumn("__row", F.row_number().over(place)).join(at, ["__source", "size", "__bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    offset = unit_interval(F.col("source"), F.lit(SEED))
    number = F.col("__before") + F.col("__row")
    copies = F.floor(number * rate + offset) - F.floor((number - 1) * rate + offset)
    placed = placed.withColumn("copies", F.least(copies, F.lit(MAX_COPIES)).cast("long"))
    return placed.drop("__source", "__bucket", "__row", "__before")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` and, for rows without an id, ``tie``, a digest of the text."""
    body = text_of(f"`{text}`")
    return docs.withColumn("size", count_words(body)).withColumn("tie", F.when(F.col("doc_id").isNull(), F.md5(body)).otherwise(F.lit("")))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    clear = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("__doc"), "doc_id", "source", "text")
    rows = written(sized(spread(clear)).drop("text"), "sizes")
    taken = mixed(rows).where("copies > 0")
    taken = taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return taken.select(*[F.col(f"__doc.c{i}").alias(c) for i, c in enumerate(names)])


def op9_mixing(docs: DataFrame) -> DataFrame:
    rows = written(sized(spread(docs.select("doc_id", "source", "text"))).select("doc_id", "source", "size", "tie"), "sizes")
    return mixed(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_OFFSET_SQL = (
    "('0x' || substr(md5(coalesce(source, chr(0)) || chr(31) || '" + str(SEED) + "'), 1, 8))::BIGINT / 4294967296.0"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) ELSE '' END AS tie,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 3))::INT AS bucket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, {MAX_COPIES} * source_size AS bound, sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY {MAX_COPIES} * source_size::DOUBLE / weight, source NULLS LAST) AS k FROM o),
p AS (SELECT *, total - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS width FROM f),
c AS (SELECT min(k) AS k FROM p WHERE rest * weight < bound * width),
t AS (SELECT p.source, p.source_size, CASE WHEN c.k IS NULL OR p.k < c.k THEN p.bound::DOUBLE
    ELSE (p.weight * (SELECT rest FROM p, c WHERE p.k = c.k))::DOUBLE / (SELECT width FROM p, c WHERE p.k = c.k)::DOUBLE END AS target
    FROM p, c),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate, {_OFFSET_SQL.replace("source", "d.source")} AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.bucket, d.doc_id NULLS FIRST, d.tie) AS place
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (least(floor(place * rate + u) - floor((place - 1) * rate + u), {MAX_COPIES}) * size)::BIGINT AS taken FROM r
"""
