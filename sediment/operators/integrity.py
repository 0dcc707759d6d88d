"""Merkle trees over sorted runs: leaves, nodes, roots, validation, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

#: Levels that one aggregation climbs; so many leaves (2^10) are folded in one array.
CLIMB = 10


def leaves(rows: DataFrame, *run: str) -> DataFrame:
    """``run..., pos, hash``: SHA-256 of each value, numbered by key inside its run. Keys are dealt into ranges and
    numbered in each, so no task sorts a whole run."""
    hashed = rows.select(*run, "key", F.sha2(F.coalesce("value", F.lit("")), 256).alias("hash"))
    return numbered(hashed, *run, into="pos").select(*run, "pos", "hash")


def _parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(left, F.coalesce(right, F.lit(""))), 256)


def _up(hashes: Column) -> Column:
    """One level up: neighbours joined, an odd one with the empty string. The array is bound once, as it is named often."""

    def folded(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / 2).cast("int")), lambda i: _parent(F.get(h, 2 * i), F.get(h, 2 * i + 1)))

    return F.get(F.transform(F.array(hashes), folded), F.lit(0))


def _with_size(chunks: DataFrame, size: DataFrame, run: tuple[str, ...]) -> DataFrame:
    return chunks.join(size, list(run)) if run else chunks.crossJoin(size)  # one row without a run


def _climbs(leaf: DataFrame, run: tuple[str, ...]):
    """(base level, frame ``run..., pos, h, n_leaves``) for each climb: arrays of the neighbouring 2^10 nodes of a level."""
    size = leaf.groupBy(*run).agg(F.count("*").alias("n_leaves"))
    most = leaf.agg(F.max("pos")).first()[0]
    nodes, base = leaf, 0
    while most is not None:
        chunk = nodes.groupBy(*run, F.shiftright("pos", CLIMB).alias("pos")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h")
        )
        chunk = _with_size(chunk, size, run)
        yield base, chunk
        # A tree whose root lies in this climb ends here; the others go on.
        if not (most := most >> CLIMB):
            return
        top = chunk.where(F.col("n_leaves") > (1 << (base + CLIMB)))
        for _ in range(CLIMB):
            top = top.withColumn("h", _up(F.col("h")))
        nodes, base = top.select(*run, "pos", F.get("h", F.lit(0)).alias("hash")), base + CLIMB


def levels(leaf: DataFrame, *run: str) -> DataFrame:
    """The node table ``run..., level, pos, hash`` of the whole tree; level 0 holds the leaves. An aggregation yields ten
    levels from arrays of at most 1024 hashes."""
    out = leaf.select(*run, F.lit(0).alias("level"), "pos", "hash")
    for base, chunk in _climbs(leaf, run):
        h = chunk.withColumn("h0", F.col("h"))
        for k in range(1, CLIMB + 1):
            h = h.withColumn(f"h{k}", _up(F.col(f"h{k - 1}")))
        # A level exists if the one below it has two nodes at least.
        each = [F.when(F.col("n_leaves") > (1 << (base + k - 1)), F.struct(F.lit(base + k).alias("level"), F.lit(CLIMB - k).alias("shift"), F.col(f"h{k}").alias("h"))) for k in range(1, CLIMB + 1)]
        h = h.select(*run, "pos", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("l"))
        h = h.select(*run, F.col("l.level").alias("level"), F.expr("shiftleft(pos, l.shift)").alias("first"), F.posexplode("l.h").alias("i", "hash"))
        out = out.unionByName(h.select(*run, "level", (F.col("first") + F.col("i")).cast("long").alias("pos"), "hash"))
    return out


def root(leaf: DataFrame, *run: str) -> DataFrame:
    """``run..., n_leaves, root``. Ten levels at a time are folded in arrays of at most 1024 hashes; a tree of a million
    leaves takes two aggregations. A single leaf is the root; without rows the root is null."""
    found = None
    for base, chunk in _climbs(leaf, run):
        # Trees that end in this climb: an array of all their nodes, folded until one is left.
        own = chunk.where((F.col("n_leaves") <= (1 << (base + CLIMB))) & (F.col("n_leaves") > (1 << base if base else 0)))
        for _ in range(CLIMB):
            own = own.withColumn("h", F.when(F.size("h") > 1, _up(F.col("h"))).otherwise(F.col("h")))
        own = own.select(*run, "n_leaves", F.get("h", F.lit(0)).alias("root"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return leaf.groupBy(*run).agg(F.count("*").alias("n_leaves"), F.lit(None).cast("string").alias("root"))
    return found


def validate(stored: DataFrame, rows: DataFrame, *run: str) -> DataFrame:
    """``run..., valid``: whether the stored ``root`` is that of the rows; a run without rows is not valid."""
    now = root(leaves(rows, *run), *run).withColumnRenamed("root", "__now").drop("n_leaves")
    joined = stored.join(now, list(run), "left") if run else stored.crossJoin(now)
    return joined.select(*run, F.coalesce(F.col("root") == F.col("__now"), F.lit(False)).alias("valid"))


def diff(a: DataFrame, b: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes ``level, pos, hash_a, hash_b`` that differ between two stored node tables, absent ones null. ``depth`` is the highest
    level of either, looked up if not given. The trees are descended ten levels at a time, and of each ten only the nodes below ones that
    differ are compared."""
    out, above = None, None
    if depth is None:
        depth = a.select("level").unionByName(b.select("level")).agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    for low in range(depth // CLIMB * CLIMB, -1, -CLIMB):
        x, y = (t.where((F.col("level") >= low) & (F.col("level") < low + CLIMB)) for t in (a, b))
        if above is not None:
            up = F.expr(f"shiftright(pos, {low + CLIMB} - level)").alias("up")
            x, y = (t.select("*", up).join(above, "up", "left_semi").drop("up") for t in (x, y))
        both = x.withColumnRenamed("hash", "hash_a").join(y.withColumnRenamed("hash", "hash_b"), ["level", "pos"], "full_outer")
        both = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        above = both.where(F.col("level") == low).select(F.col("pos").alias("up"))
        out = both if out is None else out.unionByName(both)
    return out
