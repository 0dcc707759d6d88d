import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sediment.llm import packing as P

DIR = "/root/testdata/sf0.1"


def brute_cost(at, cost, length):
    f = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            w = at[j] - at[i]
            if w <= length:
                pad = 0 if w & (w - 1) == 0 else length - w
                f[j] = min(f[j], f[i] + pad + cost[j] + P.WINDOW_COST)
    return f[-1]


def cost_of(cuts, at, cost, length):
    price = dict(zip(at.tolist(), cost.tolist()))
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        w = b - a
        assert 0 < w <= length
        total += (0 if w & (w - 1) == 0 else length - w) + price[b] + P.WINDOW_COST
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 12))]
        n = sum(lengths)
        ends = np.array([rng.random() < 0.15 for _ in range(n)])
        at, cost = P.cut_places(lengths, ends, max(1, n - 20))
        length = rng.choice([64, 128])
        assert cost_of(P.best_cuts(at, cost, length), at, cost, length) == brute_cost(at.tolist(), cost.tolist(), length)


def texts():
    rng = random.Random(9)
    words = ["the", "Tänze.", "déjà", "x9", "of!", "\n", "😀", "<|endoftext|>", "don't", "   ", "12345", "schön?"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 900, 4000])))) for i in range(120)]
    return rows + [(500, None), (501, ""), (None, "no id."), (7000, "again"), (7000, "again"), (502, "x" * 30000), (503, "a " * 40000)]


def test_pieces_hold_every_id_once(spark):
    rows = texts()
    got = P.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    digest = P.op10_packing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.ids_crc32, r.length) for r in digest) == sorted((zlib.crc32(r.ids), len(r.ids) // 4) for r in got)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for d, x in rows:
        want[d].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, len(r.ids) // 4, r.sequence_tokens))
    for d, whole in want.items():
        if len(whole) == 1:
            ps = sorted(pieces[d])
            assert b"".join(p[1] for p in ps) == whole[0]
            assert [p[0] for p in ps] == list(np.cumsum([0] + [len(p[1]) // 4 for p in ps[:-1]])) and all(p[2] == len(whole[0]) // 4 for p in ps)
    assert sorted(pieces[7000])[0][1] == want[7000][0] and len(pieces[7000]) == 2
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n, size in sorted(parts):
            assert offset == at
            at += n
        assert at == size <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * total


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_ids_of_every_document_are_those_of_tokenizers():
    encode = P.encoder(None, None)
    texts = pq.read_table(f"{DIR}/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert len(texts) >= 10_000
    odd = ["", " ", "\n\n  \t", "<|endoftext|> x", "\u200d\u0301é", "x" * 30000, "1" * 5000, "'S 's ’s", "日本語の文", "\U0001f469\u200d\U0001f4bb", "a\r\n b", "\x00\x7f\x85\xa0"]
    for t in texts + odd:
        assert np.array_equal(encode(t or ""), encode.slow(t or "")), (t or "")[:80]


def test_a_difference_is_an_error(monkeypatch):
    encode = P.encoder(None, None)
    monkeypatch.setattr(type(encode), "slow", lambda self, text: np.zeros(1, np.uint32))
    monkeypatch.setattr(P, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [f"text {i} " * (1 + 400 * (i % 50)) for i in range(200)]})
    with pytest.raises(ValueError, match="differ on document"):
        list(P._packed(iter([batch]), None, None, 2048, 1))


def test_ids_of_any_type_and_other_columns(spark):
    d = spark.createDataFrame([("a", "one two", 1, 2), (None, "three", 3, 4)], "doc_id string, text string, start int, ids int")
    got = P.packed(d).collect()
    assert {r.doc_id for r in got} == {"a", None} and all(isinstance(r.ids, (bytes, bytearray)) for r in got)


def test_a_small_rest_becomes_powers_of_two(spark):
    got = P.op10_packing(spark.createDataFrame([(1, "one two three four five six seven eight nine ten. " * 40)], "doc_id long, text string").coalesce(1)).collect()
    sizes = {r.sequence_id: r.sequence_tokens for r in got}.values()
    assert all(s & (s - 1) == 0 for s in sizes)


def test_empty_table(spark):
    assert P.op10_packing(spark.createDataFrame([], "doc_id long, text string")).collect() == []
