import random
import zlib

import numpy as np

from sediment.llm import byte_cnn as B


def corpus(n=500, seed=1):
    """Clean prose against text with noise marks; every fourth id is held out by its checksum."""
    rng = random.Random(seed)
    vocab = ["the", "river", "über", "green", "house", "of", "walks", "été", "señor", "night", "and"]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 200]))]
        text = " ".join(words) if good else " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in words)
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = B.quality_of(*frames(spark, docs, labels)).collect()
    truth = {d: q for d, q, _ in labels}
    assert len(rows) == len(docs)
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_have_no_part(spark):
    docs, labels = corpus(160)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    a, b = (sorted(B.quality_of(*frames(spark, docs, x)).collect(), key=lambda r: r.doc_id) for x in (labels, flipped))
    assert a == b


def trained(n=300, steps=60):
    docs, labels = corpus(n)
    return B.Network(*B._descent([t.encode() for _, t in docs], np.array([q for _, q, _ in labels], np.float32), 7, steps))


def slow_score(net, text):
    """The whole network, byte by byte and filter by filter."""
    size = max(1, -(-len(text) // B.STEP)) * B.STEP
    padded = text.ljust(size, b"\0") + b"\0" * (B.WIDTH - 1)
    chunks = []
    for at in range(0, max(1, size - B.STEP), B.STEP):
        out = []
        for f in range(B.FILTERS):
            best = max(sum(float(net.tables[j][padded[p + j]][f]) for j in range(B.WIDTH)) for p in range(at, min(at + B.CHUNK, size)))
            out.append(max(best + float(net.bias[f]), 0.0))
        chunks.append(out)
    w1, b1, w2, b2 = net.dense
    x = [sum(c[f] for c in chunks) / len(chunks) for f in range(B.FILTERS)] + [max(c[f] for c in chunks) for f in range(B.FILTERS)]
    h = [max(sum(x[i] * float(w1[i][k]) for i in range(2 * B.FILTERS)) + float(b1[k]), 0.0) for k in range(B.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(a * float(b) for a, b in zip(h, w2)) + b2)))


def test_scores_match_loops_over_every_byte():
    net = trained()
    long = (" ".join(["river house of night"] * 60) + "$$$***").encode()
    for text in (b"", b"x", b"a" * 128, b"ab" * 64 + b"c", "über señor".encode(), long, long + b"%%%"):
        assert abs(net.score(text) - slow_score(net, text)) < 1e-4, text[:20]


def test_gradients_match_differences():
    rng = random.Random(5)
    texts = [B._padded(bytes(rng.randrange(97, 123) for _ in range(n))) for n in (0, 5, 130, 400, 700)]
    y, weight = np.array([1, 0, 1, 0, 1.0]), np.array([0.8, 1.2, 1, 1, 0.9])
    p = B._start(3, np.float64)
    loss, grad = B._gradients(p, texts, y, weight)
    pick = np.random.Generator(np.random.PCG64(1))
    for name, x in p.items():
        seen = 0
        for _ in range(200):
            at = tuple(int(pick.integers(n)) for n in x.shape)
            if name == "e" and not 97 <= at[0] < 123:
                continue
            step, old = 1e-6, float(x[at])
            x[at] = old + step
            up = B._gradients(p, texts, y, weight, backwards=False)[0]
            x[at] = old - step
            down = B._gradients(p, texts, y, weight, backwards=False)[0]
            x[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-5 + 1e-3 * abs(grad[name][at]), (name, at)
            if (seen := seen + 1) == 6:
                break
    assert loss > 0


def test_training_sees_the_end_of_a_long_text():
    # Only the last bytes tell the classes apart, far beyond any prefix or handful of chunks.
    rng = random.Random(2)
    body = " ".join(rng.choice(["river", "house", "night", "stone"]) for _ in range(1500))
    texts = [(body + (" #@#@#@#@" if i % 2 else " of it all")).encode() for i in range(64)]
    net = B.Network(*B._descent(texts, np.array([i % 2 for i in range(64)], np.float32), 7, 120))
    assert all((net.score(t) > 0.5) == bool(i % 2) for i, t in enumerate(texts))


def test_clashing_columns(spark):
    net = B.Network(share=0.25)
    d = spark.createDataFrame([("t", 1, 2, 3, 4, "x")], "text string, score int, __text int, value int, c0 int, `a.b` string")
    out = B.scored(d, net)
    assert out.columns == ["__text", "value", "c0", "a.b", "score"] and tuple(out.first()) == (2, 3, 4, "x", 0.25)


def test_edge_cases(spark):
    docs, labels = corpus(80)
    d, l = frames(spark, [*docs, (None, "x"), (900, None), (901, ""), (5, "again"), (902, "long " * 60000)], [*labels, (None, 1, 0), (3, None, 0)])
    rows = B.quality_of(d, l).collect()
    assert len(rows) == 85 and sum(r.doc_id == 5 for r in rows) == 2
    assert {r.score for r in rows if r.doc_id in (900, 901)}.__len__() == 1
    empty = l.limit(0)
    assert {r.score for r in B.quality_of(d, empty).collect()} == {0.5}
    assert {r.score for r in B.quality_of(d, l.where("quality = 1")).collect()} == {1.0}
    assert B.quality_of(d.limit(0), l).collect() == []
