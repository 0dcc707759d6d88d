import random
import re

import numpy as np

from sediment.llm import minhash as M
from sediment.llm.components import components


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter):
                    parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), None if d is None else low[find(i)], d is None or low[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)] + ["The", "a"]
    rows, k = [], 0
    for _ in range(25):  # groups around the threshold, chained edits included
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9)):
            rows.append((k, " ".join(words)))
            k += 1
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one"), (None, "one two"), (903, "one two"), (906, "x " * 50000)]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    got = M.op2_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)


def test_no_link_is_lost_when_the_star_misses(spark):
    # b is near a and c, which are far from each other: the star on the smallest node of a bucket isn't enough.
    rng = random.Random(1)
    rows = []
    for g in range(12):
        w = [f"g{g}x{i}" for i in range(120)]
        for k in range(6):
            rows.append((g * 10 + k, " ".join(w)))
            at = rng.randrange(0, 120)
            w[at] = f"n{g}{k}"
            w[(at + 37) % 120] = f"m{g}{k}"
    got = {r.doc_id: r.component_id for r in M.op2_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c, _ in brute(rows)}


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other words here now", "z"), (None, "a b c d e f", "n"), (4, None, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = M.deduplicated(d)
    assert out.columns == d.columns
    assert sorted(out.collect(), key=str) == sorted([r for i, r in enumerate(d.collect()) if i in (0, 3, 4, 5)], key=str)


def test_pruning_bound_and_empty_table(spark):
    ns = dict(M._LEAST)
    assert ns[120] > ns[24] and ns[120] < 0.85 * 120
    assert M.op2_near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_cover_every_pair_across_components():
    import pyarrow as pa

    sets = [np.arange(k * 1000, k * 1000 + 100, dtype=np.int64) for k in range(6)]
    sets[4] = np.concatenate([sets[1][:95], np.arange(9000, 9005)])
    with np.errstate(over="ignore"):
        sig = [M.signature(s.view(np.uint64)) for s in sets]
        keys = [M.bands(s).tolist() for s in sig]
    shared = next(k for k in range(M.BANDS) if keys[1][k] == keys[4][k])
    place = {"key": [7] * 6, "kind": pa.array([0] * 6, pa.int32()), "i": pa.array([0] * 6, pa.int32()), "j": pa.array([0] * 6, pa.int32())}
    rows = place | {"node": list(range(6)), "items": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), "component": [0, 0, 2, 3, 4, 5], "side": [0] * 6, "band": [shared] * 6, "n": [100] * 6, "signature": [s.astype(np.uint16).tobytes() for s in sig], "bands": keys}

    def links(changed):
        met = M._met(pa.table(rows | changed))
        assert met.num_rows <= 6 and set(met.column("node").to_pylist()) >= {x for link in M._blockwise(pa.table(rows | changed)).to_pylist() for x in link.values()}
        return M._blockwise(met).to_pylist() if met.num_rows else []

    assert links({}) == [{"a": 1, "b": 4}]
    assert links({"side": [0, 0, 0, 1, 1, 1]}) == [{"a": 1, "b": 4}]
    assert links({"band": [shared + 1] * 6}) == []
    assert links({"component": [0, 0, 2, 3, 0, 5]}) == []


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(100)] for x in "ab")
    near = lambda w: " ".join(w[:50] + ["other"] + w[51:])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (3, " ".join(b)), (5, " ".join(a)), (5, None), (None, near(a)), (11, "alone")]
    got = M.op2_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = brute(rows)
    assert {r[2] for r in want if r[0] == 7} == {5} and {r[2] for r in want if r[0] == 9} == {3}
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_a_long_text_of_distinct_words(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59_000])), (3, " ".join(words[:30_000])), (4, " ".join(words[30_000:]))]
    got = M.op2_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_one_bucket_of_many_open_nodes_sends_each_set_about_once(spark, monkeypatch):
    # Nodes that share a band but are not near: signatures alone are compared, no set is sent.
    with np.errstate(over="ignore"):
        common = M.signature(M.shingles(" ".join(f"c{i}" for i in range(50)).encode()))
        sigs = []
        rng = np.random.Generator(np.random.PCG64(4))
        for _ in range(3000):
            s = rng.integers(0, 1 << 32, M.PERMUTATIONS, dtype=np.uint64)
            s[: M.ROWS] = common[: M.ROWS]
            sigs.append((s.astype(np.uint16).tobytes(), M.bands(s).tolist()))
    nodes = spark.createDataFrame([(i, 100, s, k) for i, (s, k) in enumerate(sigs)], "node long, n_shingles long, signature binary, bands array<long>")
    asked = []
    monkeypatch.setattr(M, "_sets", lambda ids, docs: asked.append(ids.count()) or ids.select("node", M.F.array().cast("array<long>").alias("items")))
    rows, likely = M._stars(nodes, 85)
    assert rows.where("c = 3000").count() == 3000 and likely.count() == 0
    found = spark.createDataFrame([], "node long, component long")
    assert M._rest(rows, nodes, found, None, 85).count() == 0 and asked == [0]


def test_a_block_never_gives_more_rows_than_it_got():
    import pyarrow as pa

    # All pairs near by their signatures, each node a component of its own.
    with np.errstate(over="ignore"):
        s = M.signature(np.arange(100, dtype=np.uint64))
        keys = M.bands(s).tolist()
    n = 60
    rows = {"key": [7] * n, "kind": [0] * n, "i": [0] * n, "j": [0] * n, "node": list(range(n)), "component": list(range(n)), "side": [0] * n, "band": [0] * n, "n": [100] * n, "signature": [s.astype(np.uint16).tobytes()] * n, "bands": [keys] * n}
    met = M._met(pa.table(rows))
    assert met.num_rows == n
    items = pa.array([list(range(100))] * n, pa.list_(pa.int64()))
    assert M._blockwise(met.append_column("items", items)).num_rows == n - 1


def test_hubs_are_split_and_lose_no_pair(spark):
    n = 3 * M.HUB
    pairs = spark.createDataFrame([(0, i) for i in range(1, n)] + [(5, 6), (7, 0)], "a long, b long")
    table = spark.range(n).select(M.F.col("id").alias("node"), (M.F.col("id") * 10).alias("x"))
    got = M._to_both(pairs, table, "x")
    assert got.select("part").distinct().count() == 3
    assert sorted((r.a, r.b, r.x_a, r.x_b) for r in got.collect()) == sorted((a, b, 10 * a, 10 * b) for a, b in [(0, i) for i in range(1, n)] + [(5, 6), (7, 0)])


def test_large_group_of_chained_edits(spark):
    # Edits of one text, from slight to beyond the threshold, more of them than a block holds.
    rng = random.Random(6)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for k in range(420):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"e{k}"
        rows.append((k, " ".join(w)))
    got = M.op2_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(got[x] == parent[x] for a, b in edges if a != b for x in (a, b))
