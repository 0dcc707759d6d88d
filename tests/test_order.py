"""Places in an order and Merkle trees over ranges, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import bloom
from sediment.functions.hashing import hex_modulo
from sediment.operators import integrity
from sediment.operators.order import numbered, running


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    """All levels, an odd node joined with the empty string."""
    out = [leaves]
    while len(out[-1]) > 1:
        h = out[-1]
        out.append([sha(h[i] + (h[i + 1] if i + 1 < len(h) else "")) for i in range(0, len(h), 2)])
    return out


def test_numbers_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(9)) for k in rng.sample(range(10_000), 700)]
    d = spark.createDataFrame(rows, "g string, key int, x int").repartition(5)
    by, seen, total = {}, {}, {}
    for g, k, x in sorted(rows, key=lambda r: r[1]):
        by[k] = (seen.get(g, 0), total.get(g, 0))
        seen[g], total[g] = seen.get(g, 0) + 1, total.get(g, 0) + x
    assert {r.key: r.rn for r in numbered(d, "g").collect()} == {k: v[0] for k, v in by.items()}
    assert {r.key: r.s for r in running(d, "x", "g", order="key", into="s").collect()} == {k: v[1] for k, v in by.items()}
    everything = [k for _, k, _ in sorted(rows, key=lambda r: r[1])]
    assert {r.key: r.rn for r in numbered(d).collect()} == {k: i for i, k in enumerate(everything)}
    assert numbered(d.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2049, 5000])
def test_trees_of_any_size(spark, n):
    d = spark.range(n).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("key"), (F.col("id") * 3).cast("string").alias("value"))
    want = tree([sha(str(i * 3)) for i in range(n)])
    leaf = integrity.leaves(d)
    assert integrity.root(leaf).first() == (n, want[-1][0])
    if n in (1, 3, 1025, 5000):
        got = {(r.level, r.pos): r.hash for r in integrity.levels(leaf).collect()}
        assert got == {(level, i): h for level, hs in enumerate(want) for i, h in enumerate(hs)}


def test_trees_by_run_and_their_differences(spark):
    sizes = {"a": 1, "b": 1500, "c": 1024, "d": 7}
    d = spark.createDataFrame([(r, f"{i:05d}", f"{r}{i}") for r, n in sizes.items() for i in range(n)], "run string, key string, value string")
    got = {r.run: (r.n_leaves, r.root) for r in integrity.root(integrity.leaves(d, "run"), "run").collect()}
    assert got == {r: (n, tree([sha(f"{r}{i}") for i in range(n)])[-1][0]) for r, n in sizes.items()}
    old, new = [sha(f"x{i}") for i in range(1500)], [sha(f"x{i}" if i not in (3, 1200) else "y") for i in range(1500)]
    for a, b in ((old, new), (old, old[:1100]), (old[:5], old), (old, old)):
        ta, tb = tree(a), tree(b)
        table = lambda t: spark.createDataFrame([(level, i, h) for level, hs in enumerate(t) for i, h in enumerate(hs)], "level int, pos long, hash string")
        flat = lambda t: {(level, i): h for level, hs in enumerate(t) for i, h in enumerate(hs)}
        x, y = flat(ta), flat(tb)
        want = {(*k, x.get(k), y.get(k)) for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
        assert {tuple(r) for r in integrity.diff(table(ta), table(tb)).collect()} == want
    assert integrity.root(integrity.leaves(d.limit(0).drop("run"))).first().root is None


def test_packed_filters_miss_no_key(spark):
    rows = [(g, f"{g}{i}") for g, n in (("a", 1), ("b", 300), ("c", 40)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, key string")
    f = bloom.packed(d, 0.01, 1 << 20, "g")
    sizes = {r.g: (r.m, r.k, len(r.words)) for r in f.collect()}
    assert {g: m for g, (m, _, _) in sizes.items()} == {g: bloom.bits_for(n, 0.01) for g, n in (("a", 1), ("b", 300), ("c", 40))}
    assert all(w == -(-m // bloom.WORD) for m, _, w in sizes.values())
    bounds = d.groupBy("g").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    probes = d.select("key").union(spark.createDataFrame([(f"b{i}x",) for i in range(400)], "key string"))
    got = {tuple(r) for r in bloom.gate(f.join(bounds, "g"), "g", probes, 7).collect()}
    assert set(rows) <= got and len(got) < len(rows) + 30
    assert {r.g for r in bloom.packed(d, 0.01, 500, "g").collect()} == {"a", "c"}
    met = {tuple(r) for r in bloom.within_bounds(bounds, "g", probes.distinct()).collect()}
    span = {r.g: (r.min_key, r.max_key) for r in bounds.collect()}
    assert met == {(g, r.key) for g, (lo, hi) in span.items() for r in probes.distinct().collect() if lo <= r.key <= hi}
    with pytest.raises(ValueError):
        hex_modulo(F.col("x"), 1 << 31)
