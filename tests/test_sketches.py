"""Sketches, hashes, trees and the codec against plain Python."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sediment.functions import bloom, cms, hll, serial, simhash
from sediment.functions.hashing import seed_hex
from sediment.operators import integrity, limiter
from sediment.schema import MUTATION
from sediment.sources import wal


def bits(x, i=None):
    data = str(x).encode() + (b"" if i is None else bytes.fromhex(seed_hex(i)))
    return int.from_bytes(hashlib.md5(data).digest()[:8], "big")


def strings(spark, xs, name="key"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} string")


def test_hll(spark):
    for p in (4, 11, 16):
        m = 1 << p
        items = [f"é{i}" for i in range(3000)] * 2
        reg = [0] * m
        for x in items:
            h = bits(x)
            w = ((h << p) & (2**64 - 1)) | 1 << (p - 1)
            reg[h >> (64 - p)] = max(reg[h >> (64 - p)], 65 - w.bit_length())
        d = strings(spark, [*items, None])
        got = hll.registers(d, F.col("key"), p)
        assert {r.idx: r["rank"] for r in got.collect()} == {i: r for i, r in enumerate(reg) if r}
        raw = hll.alpha(m) * m * m / sum(2.0**-r for r in reg)
        zeros = reg.count(0)
        want = int(m * math.log(m / zeros)) if raw <= 2.5 * m and zeros else int(raw)
        assert hll.estimate(got, p).first().estimate == want
        if p > 4:
            assert abs(want - 3000) < 4 * 1.04 / math.sqrt(m) * 3000
        half = hll.merge(hll.registers(d.limit(2000), F.col("key"), p), got)
        assert {tuple(r) for r in half.collect()} == {tuple(r) for r in got.collect()}
    assert hll.estimate(hll.registers(strings(spark, []), F.col("key"), 8), 8).first().estimate == 0
    with pytest.raises(ValueError):
        hll.precision(0.9)


def test_cms(spark):
    rng = random.Random(1)
    items = [f"k{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(2000)]
    truth = Counter(items)
    w, d = cms.width(0.05), cms.depth(0.05)
    cells = Counter((i, bits(x, i) % w) for x in items for i in range(d))
    s = cms.cells(strings(spark, items), F.col("key"), 0.05, 0.05)
    assert {(r.row, r.col): r.n for r in s.collect()} == cells
    got = {r.item: r.estimate for r in cms.estimate(s, strings(spark, [*truth, "absent"], "item"), 0.05, 0.05).collect()}
    assert got == {x: min(cells[i, bits(x, i) % w] for i in range(d)) for x in [*truth, "absent"]}
    assert all(got[x] >= n for x, n in truth.items())
    twice = {(r.row, r.col): r.n for r in cms.merge(s, s).collect()}
    assert twice == {k: 2 * n for k, n in cells.items()}


def test_bloom(spark):
    keys = [f"ключ{i}" for i in range(200)]
    m = bloom.bits_for(200, 0.01)
    k = bloom.hashes_for(200, m)
    table = {bits(x, i) % m for x in keys for i in range(k)}
    b = bloom.build(strings(spark, keys), m, k)
    assert {r.bit for r in b.collect()} == table
    probes = keys + [f"no{i}" for i in range(500)]
    got = {r.key: r.present for r in bloom.check(b, strings(spark, probes), m, k).collect()}
    assert got == {x: all(bits(x, i) % m in table for i in range(k)) for x in probes}
    assert all(got[x] for x in keys) and sum(got.values()) < 200 + 25
    assert (bloom.bits_for(25, 0.01), bloom.hashes_for(25, 240)) == (240, 7)
    p = bloom.prefixes(strings(spark, ["abc", "ab", "x", ""]), 2, 3)
    assert {r.key for r in p.collect()} == {"ab", "abc"}
    pb = bloom.build(p, m, k)
    got = {r.key: r.present for r in bloom.check_prefixes(pb, strings(spark, ["a", "ab", "abc", "abcdef", "zz"]), m, k, 2, 3).collect()}
    assert got == {"a": True, "ab": True, "abc": True, "abcdef": True, "zz": False}


def test_simhash(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    for i in range(60, 110):  # near copies
        w = (docs[i - 60][1] + " x").split()
        w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, docs[0][1])]

    def plain(text):
        v = [0] * 64
        for t in (text or "").split():
            h = bits(t)
            for i in range(64):
                v[i] += 1 if h >> i & 1 else -1
        return sum(1 << i for i in range(64) if v[i] > 0)

    d = spark.createDataFrame(docs, "doc_id long, text string")
    h = simhash.simhash(d, "doc_id", simhash.tokens(F.col("text")))
    want = {i: plain(t) for i, t in docs}
    assert {r.doc_id: r.hash % (1 << 64) for r in h.collect()} == want
    first = {}
    for i in sorted(want):
        first.setdefault(want[i], i)
    pairs = {(a, b): bin(x ^ y).count("1") for x, a in first.items() for y, b in first.items() if a < b and bin(x ^ y).count("1") <= 3}
    got = {(r.a, r.b): r.distance for r in simhash.near_pairs(simhash.classes(h, "doc_id")).collect()}
    assert got == pairs
    links = {r.doc_id: (r.class_id, r.n_links) for r in simhash.links(h, "doc_id").collect()}
    assert links == {i: (first[x], sum(bin(x ^ y).count("1") <= 3 for j, y in want.items() if j != i)) for i, x in want.items()}
    for bad in (-1, 65):
        with pytest.raises(ValueError):
            simhash.compare(F.lit(1), F.lit(2), bad)


def test_near_pairs_miss_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(4):
            x = b
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            rows.append(x)
    rows = sorted(set(rows))
    d = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x, i) for i, x in enumerate(rows)], "hash long, rep long")
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if bin(rows[i] ^ rows[j]).count("1") <= 3}
    assert {(r.a, r.b) for r in simhash.near_pairs(d).collect()} == want


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(values):
    level, out = [sha(v) for v in values], []
    while True:
        out.append(level)
        if len(level) == 1:
            return out
        level = [sha(level[i] + (level[i + 1] if i + 1 < len(level) else "")) for i in range(0, len(level), 2)]


def test_merkle(spark):
    for n in (1, 2, 3, 5, 16, 25, 1023, 1024, 1025, 2500):
        values = [f"v{i}" for i in range(n)]
        d = spark.createDataFrame([(f"{i:05d}", v) for i, v in enumerate(values)], "key string, value string")
        tree = plain_tree(values)
        assert integrity.root(integrity.leaves(d)).first() == (n, tree[-1][0])
        if n <= 25:
            nodes = {(r.level, r.pos): r.hash for r in integrity.levels(integrity.leaves(d)).collect()}
            assert nodes == {(i, j): h for i, level in enumerate(tree) for j, h in enumerate(level)}


def test_merkle_runs_validate_and_diff(spark):
    sizes = {"a": 1, "b": 7, "c": 1300}
    rows = [(r, f"{i:05d}", f"{r}{i}") for r, n in sizes.items() for i in range(n)]
    d = spark.createDataFrame(rows, "run string, key string, value string")
    roots = integrity.root(integrity.leaves(d, "run"), "run")
    assert {r.run: r.root for r in roots.collect()} == {r: plain_tree([v for x, _, v in rows if x == r])[-1][0] for r in sizes}
    small = d.where("run <> 'c'")
    nodes = {(r.run, r.level, r.pos): r.hash for r in integrity.levels(integrity.leaves(small, "run"), "run").collect()}
    assert nodes == {(r, i, j): h for r in "ab" for i, level in enumerate(plain_tree([v for x, _, v in rows if x == r])) for j, h in enumerate(level)}
    spoilt = d.withColumn("value", F.when((F.col("run") == "b") & (F.col("key") == "00003"), "bad").otherwise(F.col("value")))
    assert {r.run: r.valid for r in integrity.validate(roots.select("run", "root"), spoilt, "run").collect()} == {"a": True, "b": False, "c": True}
    one, two = (integrity.levels(integrity.leaves(x.where("run = 'b'").select("key", "value"))) for x in (d, spoilt))
    assert {(r.level, r.pos) for r in integrity.diff(one, two).collect()} == {(0, 3), (1, 1), (2, 0), (3, 0)}


def test_wal_codec(spark):
    rows = [(1, 1700000000, "u", "PUT", "ключ", "välue\n"), (2, 5, "u", "DELETE", "k", ""), (3, 2**40, None, "PUT", "x" * 500, ""), (4, 0, "v", "PUT", "k", "😀")]
    d = spark.createDataFrame(rows, MUTATION)
    rec = wal.encode(d)
    for r, (seq, ts, _, op, k, v) in zip(rec.orderBy("seq").collect(), rows):
        k, v = k.encode(), v.encode()
        body = struct.pack("<qBQQ", ts, op == "DELETE", len(k), len(v)) + k + v
        assert bytes(r.record) == struct.pack("<I", zlib.crc32(body)) + body
    back = wal.decode(rec)
    assert back.where("valid").count() == 4
    assert {tuple(r) for r in back.select(*[f.name for f in MUTATION.fields]).collect()} == set(rows)
    torn = rec.union(spark.createDataFrame([(9, "u", bytearray(b"\x01\x02")), (10, "u", bytearray(b"")), (11, "u", bytearray(b"\xff" * 40))], rec.schema))
    flipped = torn.withColumn("record", F.when(F.col("seq") == 4, F.unhex(F.concat(F.substring(F.hex("record"), 1, 60), F.lit("00"), F.substring(F.hex("record"), 63, 999)))).otherwise(F.col("record")))
    assert {r.seq: r.valid for r in wal.decode(flipped).collect()} == {1: True, 2: True, 3: True, 4: False, 9: False, 10: False, 11: False}
    assert {r.key: r.value for r in wal.replay(rec).collect()} == {"ключ": "välue\n", "x" * 500: "", "k": "😀"}
    assert {r.key for r in wal.replay(flipped).collect()} == {"ключ", "x" * 500}


@pytest.mark.parametrize("strict", [False, True])
def test_limiter_replay_is_the_online_check(spark, strict):
    rng = random.Random(7)
    rows, clock = [], 0
    for s in range(300):
        clock += rng.randrange(0, 30)
        rows.append((rng.choice("abc"), s, clock))
    now = [0]
    online = limiter.Limiter(3, 0.02, lambda: now[0], strict)
    want = {}
    for u, s, t in rows:
        now[0] = t
        want[s] = (online.allows(u), online.buckets[u][0])
    got = limiter.replay(spark.createDataFrame(rows, "user string, seq long, ts long"), 3, 0.02, strict)
    assert {r.seq: (r.allowed, r.tokens) for r in got.collect()} == want
    assert {a for a, _ in want.values()} == {True, False} or not strict


def test_sketches_as_bytes(spark):
    d = strings(spark, [f"k{i % 37}" for i in range(300)])
    reg = hll.registers(d, F.col("key"), 6)
    raw = serial.hll_bytes(reg, 6)
    body = bytes(raw.first().sketch)
    assert body[:5] == struct.pack(">BI", 6, 64) and list(body[5:]) == [{r.idx: r["rank"] for r in reg.collect()}.get(i, 0) for i in range(64)]
    assert {tuple(r) for r in serial.hll_registers(raw.union(raw)).collect()} == {tuple(r) for r in reg.collect()}
    cells = cms.cells(d, F.col("key"), 0.2, 0.2)
    w, n = cms.width(0.2), cms.depth(0.2)
    raw = serial.cms_bytes(cells, w, n)
    table = {(r.row, r.col): r.n for r in cells.collect()}
    assert bytes(raw.first().sketch) == b"CMS1\x01" + struct.pack(f">II{w * n}Q", w, n, *[table.get(divmod(i, w), 0) for i in range(w * n)])
    assert {(r.row, r.col): r.n for r in serial.cms_cells(raw.union(raw)).collect()} == {k: 2 * v for k, v in table.items()}
    with pytest.raises(Exception, match="not a Count-Min sketch"):
        serial.cms_cells(spark.createDataFrame([(bytearray(b"other bytes here"),)], "sketch binary")).collect()
    bits_ = bloom.build(d, 500, 3)
    raw = serial.bloom_bytes(bits_, 500, 3)
    assert len(raw.first().sketch) == 8 + 500 + 12
    assert {r.bit for r in serial.bloom_bits(raw).collect()} == {r.bit for r in bits_.collect()}
    for h in (0, 5, -1, -(1 << 63)):
        r = spark.range(1).select(serial.simhash_bytes(F.lit(h)).alias("b")).select("b", serial.simhash_of(F.col("b")).alias("h")).first()
        assert bytes(r.b) == struct.pack(">q", h) and r.h == h


def test_gate_names_every_run_that_holds_a_key(spark):
    rows = [(i % 4, f"k{i * 13 % 101}") for i in range(200)]
    d = spark.createDataFrame(rows, "run int, key string")
    bounds = d.groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    filters = bloom.packed(d, 0.01, 1 << 20, "run").join(bounds, "run")
    got = {(r.run, r.key) for r in bloom.gate(filters, "run", strings(spark, [f"k{i}" for i in range(150)]), filters.first().k).collect()}
    assert set(rows) <= got and len(got) < len(set(rows)) + 40
