"""Near-duplicates: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct 5-word shingles (words are runs of anything but U+0020 and U+0009
to U+000D, A-Z lower-cased; with fewer words the whole sequence is one shingle; without words the set is
empty and linked with nothing). Two documents are linked if 100 * |A and B| >= percent * |A or B|; ``percent`` is
``PERCENT`` (85) in ``op2_near_dedup`` and ``STAGE_PERCENT`` (80) in the pipeline's stage.

1. *Sketch.* One pass over the texts gives each document the size of its set, a 128-bit digest of it and
   a signature of ``PERMUTATIONS`` minima; the sketch is written to the shared folder. Documents with
   equal sets form a class; from here on one node stands for a class, so a group of copies of any size
   is one node.
2. *Candidates.* Nodes that agree on one of the bands of minima share a bucket. Bands are as long as they may be for
   a pair at the threshold to miss all of them with probability under ``MISS``: 24 of 5 minima at 85 (8e-7), 30 of 4
   at 80 (1.4e-7).
3. *Stars.* In each bucket every node is compared with the smallest one.
4. *Sequential Bayesian verification.* Signatures are compared ``BATCH`` minima at a time. With a
   uniform prior and m of n matches the similarity has the posterior Beta(m + 1, n - m + 1); a pair is
   dropped as soon as its posterior probability of reaching the threshold is under ``MISS``. (The sizes
   of the sets bound the similarity from above, exactly.)
5. *Exact.* The full sets of the survivors decide.
6. *The rest.* Buckets that still hold more than one component are compared further: nodes outside a bucket's largest
   component with each other and with that component, in blocks of about ``BLOCK`` nodes and ``ITEMS`` shingles by as
   many. First only signatures meet, and nodes without company leave. Then the sets of those that stay are sent to their
   blocks, and steps 4 and 5 are done in memory, a pair once, in the first band its nodes share, and not at all once its
   ends are in one component. Only links that join components are emitted.
   So no link that a bucket shows is lost to the stars, no group's pairs are compared as rows, and a group whose stars
   joined it sends its sets once.

The result has a row per input row. A row without an id is linked with nothing, its component is null
and it is kept. Rows that repeat an id and a text fall in one class; texts that share an id are documents of their own,
and a component's id is the smallest id in it. An empty table gives an empty result.
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plan import spread
from .common import arrow_batches, discard, settled, written
from .components import components

SHINGLE = 5
PERCENT, STAGE_PERCENT = 85, 80
PERMUTATIONS = 120
BATCH = 24
MISS = 1e-6
BLOCK = 256
#: Shingles of a block, on average; a block holds one node at least.
ITEMS = 1 << 20
#: Partners of a node that one task gets; a node with more is sent to several.
HUB = 256
#: Tasks that the rows of one bucket are dealt over.
SPLIT = 8
#: Ids that may be broadcast to pick the texts whose sets are needed; with more, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows that a Python worker holds at once.
BATCH_ROWS = 512
#: Bytes of a text that are split into words at once.
PIECE = 1 << 22

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.Generator(np.random.PCG64(20240229))
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND = _rng.integers(0, 1 << 63, 2 * PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>"


def least_matches(n: int, threshold: float = PERCENT / 100, miss: float = MISS) -> int:
    """The fewest matches in n minima with which a pair may still reach the threshold: under that,
    P(similarity >= threshold) < miss. The tail of Beta(m + 1, n - m + 1) is a binomial sum."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


@lru_cache
def _least(percent: int) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent / 100)) for n in range(BATCH, PERMUTATIONS + 1, BATCH)]


@lru_cache
def layout(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, minima of each): the longest bands that a pair at the threshold misses with probability under MISS."""
    rows = [r for r in range(1, PERMUTATIONS + 1) if PERMUTATIONS % r == 0 and (1 - (percent / 100) ** r) ** (PERMUTATIONS // r) < MISS]
    if not rows:
        raise ValueError(f"{PERMUTATIONS} minima are too few for a threshold of {percent} percent")
    return PERMUTATIONS // max(rows), max(rows)


_LEAST = _least(PERCENT)
BANDS, ROWS = layout()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        words = text[at:end].translate(_LOWER).split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The set of a text, as sorted 64-bit hashes."""
    h = word_hashes(text)
    if not len(h):
        return h
    if len(h) < SHINGLE:
        whole = np.uint64(len(h))
        for k in range(len(h)):
            whole = whole + h[k] * _PLACE[k]
        return _mixed(np.array([whole], np.uint64))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        s += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 1024):
        v = s[None, at : at + 1024] * _A[:, None] + _B[:, None]
        np.minimum(low, (v >> np.uint64(32)).min(axis=1), out=low)
    return low


def bands(sig: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n, rows = layout(percent)
    k = _BAND[: n * (rows + 1)].reshape(n, rows + 1)
    v = (sig.reshape(n, rows) * k[:, :rows]).sum(axis=1, dtype=np.uint64) + k[:, rows]
    return _mixed(v).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            n, sets, sigs, keys = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py() or b"")
                n.append(len(s))
                if not len(s):
                    sets.append(None), sigs.append(None), keys.append(None)
                    continue
                sig = signature(s)
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(sig.astype(np.uint16).tobytes())
                keys.append(bands(sig, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "signature", "bands"],
            )


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    return spread(docs.select("doc_id", F.col("text").cast("binary"))).mapInArrow(lambda b: _sketched(b, percent), SKETCH)


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, text in enumerate(batch.column(1)):  # one text a batch: sets may be large
                s = shingles(text.as_py() or b"").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([s], pa.list_(pa.int64()))], names=["node", "items"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(len(column), PERMUTATIONS)


def _likely(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the rows of a and b that no batch of minima prunes."""
    left, m = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in _least(percent):
        m += (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1)
        stay = m >= least
        left, m = left[stay], m[stay]
    return left


def _pruned(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stay = _likely(_matrix(batch.column("sa")), _matrix(batch.column("sb")), percent) if len(batch) else np.empty(0, np.int64)
        yield batch.select(["a", "b"]).take(pa.array(stay))


def _met(rows: pa.Table, percent: int = PERCENT) -> pa.Table:
    """The rows of a block's nodes that have company there: a node of another component that no batch of minima prunes, if
    this is the first band that both share. At most as many rows as came, whatever the number of such pairs."""
    comp, side, band, n = (rows.column(c).to_numpy() for c in ("component", "side", "band", "n"))
    sig = _matrix(rows.column("signature").combine_chunks())
    keys = np.array(rows.column("bands").to_pylist(), np.int64).reshape(len(n), layout(percent)[0])
    one = bool((side == side[0]).all())
    left = np.flatnonzero(side == side[0])
    right = left if one else np.flatnonzero(side != side[0])
    stays = np.zeros(len(side), bool)
    for i in left:
        to = right[right > i] if one else right
        # Pairs of nodes that both stay need no look.
        to = to[(comp[to] != comp[i]) & ~(stays[to] & stays[i]) & (100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i]))]
        to = to[~(keys[to, : band[i]] == keys[i, : band[i]]).any(axis=1)]
        if len(to):
            to = to[_likely(np.broadcast_to(sig[i], (len(to), PERMUTATIONS)), sig[to], percent)]
            stays[to] = True
            stays[i] |= len(to) > 0
    return rows.filter(pa.array(stays))


class _Forest:
    """Union-find over the components that meet in one block."""

    def __init__(self, labels: np.ndarray):
        self.own = np.unique(labels, return_inverse=True)[1]
        self.up = list(range(int(self.own.max()) + 1)) if len(labels) else []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def of(self, rows: np.ndarray) -> np.ndarray:
        flat = np.array([self.root(x) for x in range(len(self.up))])
        return flat[self.own[rows]]

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(int(self.own[i])), self.root(int(self.own[j]))
        self.up[max(a, b)] = min(a, b)
        return a != b


def _common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of one sorted set with many."""
    flat = np.concatenate(many)
    at = one.searchsorted(flat)
    at[at == len(one)] = 0
    return np.add.reduceat(one[at] == flat, np.cumsum([0, *map(len, many[:-1])]))


def _blockwise(rows: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links across components in one block of a bucket, as many as join components.

    A pair is looked at in the first band that its nodes share. Signatures prune it, full sets decide; what is
    joined by then needs no look.
    """
    node, comp, side, band, n = (rows.column(c).to_numpy() for c in ("node", "component", "side", "band", "n"))
    sig = _matrix(rows.column("signature").combine_chunks())
    keys = np.array(rows.column("bands").to_pylist(), np.int64).reshape(len(node), layout(percent)[0])
    items = [np.asarray(x.values).view(np.uint64) for x in rows.column("items").combine_chunks()]
    one = bool((side == side[0]).all()) if len(side) else True
    left = np.flatnonzero(side == side[0]) if len(side) else side
    right = left if one else np.flatnonzero(side != side[0])
    forest = _Forest(comp)
    out_a, out_b = [], []
    for i in left:
        to = right[right > i] if one else right
        to = to[100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i])]
        to = to[~(keys[to, : band[i]] == keys[i, : band[i]]).any(axis=1)]
        to = to[forest.of(to) != forest.root(int(forest.own[i]))]
        if len(to):
            to = to[_likely(np.broadcast_to(sig[i], (len(to), PERMUTATIONS)), sig[to], percent)]
        if len(to):
            both = _common(items[i], [items[j] for j in to])
            for j in to[100 * both >= percent * (n[i] + n[to] - both)]:
                if forest.join(i, j):
                    out_a.append(node[i]), out_b.append(node[j])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _close(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, items``: the full sets of the documents with the ids ``node``."""
    ids = written(ids.distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("body")).join(few, "node", "left_semi")
    sets = written(texts.mapInArrow(_as_sets, "node long, items array<long>"), "sets")
    discard(ids)
    return sets


def _hubs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with ``part``, which deals the partners ``b`` of a node ``a`` over tasks, and the nodes ``a`` with more than
    one part, ``a, parts``."""
    hubs = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"), "hubs")
    few = F.broadcast(hubs) if hubs.count() <= BROADCAST_IDS else hubs
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    return pairs.join(few, "a", "left").withColumn("part", part.cast("int")).drop("parts"), few


def _to_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Each pair with the columns of its nodes, as ``<column>_a`` and ``<column>_b``. The columns of a node ``a`` are sent
    once per part, those of ``b`` once per pair."""
    split, hubs = _hubs(pairs)
    out = split.join(table.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns]), "b")
    own = table.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns]).join(hubs, "a", "left")
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return out.join(own, ["a", "part"])


def _exact(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    pairs = written(pairs.distinct(), "pairs")
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs)
    both = _to_both(pairs, sets, "items")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    links = written(both.where(100 * common >= percent * union).select("a", "b").distinct(), "links")
    discard(pairs, sets)
    return links


def _by_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (``key, node, ...``) with the columns of their bucket. A bucket's row is sent to ``SPLIT`` tasks, which share
    its rows."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SPLIT)).cast("int"))
    return dealt.join(buckets.withColumn("__part", parts), ["key", "__part"]).drop("__part")


def _stars(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows ``key, node, band, rep, c`` of buckets with company, survivors of the comparison with ``rep``)."""
    spread = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("c")).where("c > 1")
    rows = written(_by_bucket(spread, buckets), "buckets")
    pairs = rows.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    both = _to_both(written(pairs, "stars"), nodes, "signature", "n_shingles")
    both = both.where(_close("n_shingles_a", "n_shingles_b", percent)).select("a", "b", F.col("signature_a").alias("sa"), F.col("signature_b").alias("sb"))
    return rows, both.mapInArrow(lambda b: _pruned(b, percent), "a long, b long")


def _rest(rows: DataFrame, nodes: DataFrame, found: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links across components in buckets of three and more nodes, enough of them to join what is linked."""
    own = nodes.select("node", F.col("n_shingles").alias("n")).join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    rows = rows.where("c > 2").select("key", "node", "band").join(own, "node")
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    buckets = parts.groupBy("key").agg(F.count("*").alias("p"), F.sum("m").alias("c"), F.sum("s").alias("s"), F.max(F.struct("m", "component", "s")).alias("main")).where("p > 1")
    blocks = lambda count, items: F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(items / F.lit(ITEMS))).cast("int")
    buckets = buckets.select(
        "key", F.col("main.component").alias("main"), blocks(F.col("main.m"), F.col("main.s")).alias("inner"),
        blocks(F.col("c") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("outer"),
    )
    rows = written(_by_bucket(rows, buckets), "open")
    inside = F.col("component") == F.col("main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int"))

    def place(kind: int, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    zero = F.lit(0)
    all_of = lambda n: F.sequence(zero, F.col(n) - 1)
    others = F.transform(all_of("outer"), lambda k: place(0, F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.col("own") > k))
    mains = F.transform(all_of("inner"), lambda k: place(1, F.col("own"), k, F.lit(0)))
    meets = F.when(inside, F.transform(all_of("outer"), lambda k: place(1, k, F.col("own"), F.lit(1)))).otherwise(F.concat(others, mains))
    rows = rows.select("key", "node", "band", "component", F.explode(meets).alias("m")).select("key", "node", "band", "component", "m.*")
    rows = rows.join(nodes.select("node", "signature", "bands", F.col("n_shingles").alias("n")), "node")
    block = ["key", "kind", "i", "j"]
    company = written(rows.groupBy(*block).applyInArrow(lambda t: _met(t, percent), rows.schema), "company")
    sets = _sets(company.select("node"), docs)
    links = company.join(sets, "node").groupBy(*block).applyInArrow(lambda t: _blockwise(t, percent), "a long, b long")
    return written(links.distinct(), "links")


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """If some id has several texts: ``docs`` with a number of (id, text) in ``doc_id``'s place, ``__id`` in its own, and the table of
    numbers, which ascend with the ids. Otherwise None; ids alone are read if none repeats."""
    ids = docs.where("doc_id IS NOT NULL")
    again = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = written(again, "again")
    if again.isEmpty() or ids.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(_digest()).alias("lo"), F.max(_digest()).alias("hi")).where("lo < hi").isEmpty():
        return None
    names = ids.select("doc_id", _digest().alias("__digest")).distinct()
    keys = written(names.orderBy("doc_id", "__digest").withColumn("__key", F.monotonically_increasing_id()).withColumnRenamed("doc_id", "__id"), "keys")
    given = docs.withColumn("__digest", _digest())
    given = given.join(keys.withColumnRenamed("__digest", "__of"), (given["doc_id"] == F.col("__id")) & (given["__digest"] == F.col("__of")), "left")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    return written(given.select(F.col("__key").alias("doc_id"), *rest, given["doc_id"].alias("__id")), "keyed"), keys


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, set_id, component_id, kept`` for each row of ``docs`` (``doc_id, text``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make() -> DataFrame:
        keyed = _keyed(docs)
        if keyed is None:
            return _linked(docs, percent)
        given, keys = keyed
        by_key = _linked(given.select("doc_id", "text"), percent)
        names = keys.select(F.col("__key"), F.col("__id"))
        out = by_key.join(names.toDF("doc_id", "id"), "doc_id", "left").join(names.toDF("component_id", "of"), "component_id", "left")
        out = out.select(F.col("id").alias("doc_id"), "n_shingles", "set_id", F.col("of").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    return settled(make, "linked")


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        every = written(sketch(docs, percent), "sketch")
        classes = every.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"), F.first("bands").alias("bands"),
        )
        nodes = written(classes, "nodes")
        rows, likely = _stars(nodes, percent)
        links = _exact(likely, docs, percent)
        found = components(links)
        more = _rest(rows, nodes, found, docs, percent)
        if not more.isEmpty():
            found = components(links.union(more))
    label = nodes.select("set_id", "node", "copies").join(found, "node", "left")
    label = label.select("set_id", F.coalesce("component", "node").alias("component"), "copies", "node")
    label = label.where("copies > 1 OR component <> node").select("set_id", "component")
    out = every.select("doc_id", "n_shingles", "set_id").join(label, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", "set_id", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and all that have no id. Texts that share an id are decided
    on one by one."""
    # Under names of their places, no column of docs can clash with one in here.
    names = docs.columns
    clear = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    keyed = _keyed(clear)
    kept = _undropped(clear if keyed is None else keyed[0], percent)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _digest():
    return F.xxhash64("text")


def _undropped(docs: DataFrame, percent: int) -> DataFrame:
    """The rows that stay, where an id has one text."""
    gone = settled(lambda: _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent), "decisions")
    again = not gone.where("doc_id IS NOT NULL").groupBy("doc_id", "set_id").count().where("count > 1").isEmpty()
    drop = written(gone.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    few = F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop
    kept = docs.join(few, docs["doc_id"] == few["__gone"], "left_anti")
    discard(gone)
    if not again:
        return kept
    none = kept.where("doc_id IS NULL")
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(none)


def op2_near_dedup(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {SHINGLE - 1}, least(len(ws), 1)))) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + {SHINGLE}], ' ') AS sh FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
