import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sediment.llm import mixing, pii
from sediment.llm import quality_rules as Q

from .test_minhash import brute as components
from .test_pii import brute as personal

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_stop": sum(x.lower() in Q.STOP_WORDS for x in w), "n_upper": len(re.findall("[A-Z]", t)),
    }


def good(text):
    m = measures(text)
    if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
        return False
    for r in Q.RULES:
        x = m[r.part] / m[r.whole] if m[r.whole] else 0.0
        if r.least is not None and x < r.least or r.most is not None and x > r.most:
            return False
    return True


def targets(sizes):
    """Weighted shares of the total, what is over three times a source's size dealt out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > 3 * sizes[s] * w or not sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return out


def corpus():
    rng = random.Random(21)
    vocab = "the of and river stone green walks night über été casa montaña with light under seven paper window".split() + [f"w{i}" for i in range(200)]
    rows = []
    for k in range(90):
        w = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 80, 200]))]
        if k % 9 == 0:
            w = [x + "***" for x in w]
        if k % 5 == 0:
            w.insert(3, f"a{k}@mail.example.com")
        if k % 11 == 0:
            w = w[:12] * 9
        rows.append([k, " ".join(w), "en", rng.choice(["a", "a", "a", "b", None]), 0])
    for k in range(90, 110):
        rows.append([k, rows[k - 90][1] + (" end" if k % 2 else ""), None, "c", 0])
    for r in rows:
        r[4] = len(r[1])
    rows += [[200, None, "en", "a", None], [201, "", None, None, 0], [None, " ".join(vocab), "en", "b", 5], [7, *rows[7][1:]], [202, "x" * 50000, "en", "b", 50000]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra kept", F.lit(1))


def test_measures_match_plain_python(spark, docs):
    got = Counter(tuple(r) for r in Q.measured(docs.select("doc_id", "text")).select("doc_id", *Q.MEASURES).collect())
    assert got == Counter((r[0], *[measures(r[1])[m] for m in Q.MEASURES]) for r in corpus())


def test_mixing_meets_its_targets(spark, docs):
    rows = mixing.op9_mixing(docs).collect()
    size, source = {}, {}
    for d, t, _, s, _ in corpus():
        size[d], source[d] = len(WORD.findall(t or "")), s
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    want = targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-12) and abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.op9_mixing(docs.repartition(7)).collect()), key=str)
    assert mixing.op9_mixing(docs.limit(0)).collect() == []


def test_every_stage(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "packing"]

    out = stage["quality_rules"](spark, docs, "")
    assert out.columns == docs.columns
    kept = [r for r in rows if good(r[1])]
    assert Counter(map(tuple, out.collect())) == Counter(kept)

    out = stage["near_dedup"](spark, out, "")
    assert out.columns == docs.columns
    unique = [r for r, c in zip(kept, components([r[:2] for r in kept])) if c[3]]
    unique = [r for i, r in enumerate(unique) if r[0] is None or r[:2] not in [u[:2] for u in unique[:i]]]
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == Counter(unique) and len(unique) < len(kept)

    def redact(r):
        spans = personal(r[1])
        if not spans:
            return r
        t = pii.redact(r[1], [(*s, 1.0) for s in spans])
        assert not personal(t)
        return (r[0], t, *r[2:4], len(t), *r[5:])

    out = stage["pii"](spark, spark.createDataFrame(got, docs.schema), "")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    clean = [redact(r) for r in unique]
    assert Counter(map(tuple, out.collect())) == Counter(clean) and clean != unique

    out = stage["mixing"](spark, spark.createDataFrame(clean, docs.schema), "")
    assert out.columns == docs.columns
    mixed = Counter(map(tuple, out.collect()))
    copies = {r.doc_id: (r.taken // r.size if r.size else 0) for r in mixing.op9_mixing(spark.createDataFrame(clean, docs.schema)).collect()}
    assert mixed == Counter({r: copies[r[0]] for r in clean if copies[r[0]]}) and max(mixed.values()) <= 3

    out = stage["packing"](spark, spark.createDataFrame(list(mixed.elements()), docs.schema), "")
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, sequences = Counter(), defaultdict(int)
    for r in out.collect():
        tokens[r.doc_id] += len(r.ids) // 4
        sequences[r.sequence_id] += len(r.ids) // 4
    want = Counter()
    for r, n in mixed.items():
        want[r[0]] += n * (len(model.encode(r[1], add_special_tokens=False).ids) + 1)
    assert tokens == want and max(sequences.values()) <= 2048


def test_run_reads_and_writes_through_spark(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and np.sum([len(r.ids) // 4 for r in rows]) > 1000


def test_empty_table(spark, docs):
    d = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        d = f(spark, d, "")
        assert d.collect() == []
        if "ids" not in d.columns:
            d = spark.createDataFrame([], d.schema)
