"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and run under learned filters of ``WIDTH`` bytes. Chunks of ``CHUNK`` bytes,
each overlapping the next by half, cover the whole text; in each chunk every filter is rectified and max-pooled.
The chunks' vectors are combined by their mean and their maximum, and a small dense network turns those into one
probability. As embedding and filter are linear, they are folded into ``WIDTH`` tables of 256 rows to score.

It is fitted by Adam on at most ``PER_CLASS`` labelled rows of each class (a parameter), picked by hash over the whole
table, each with its whole text: a step runs the filters over every byte of its texts, the gradient goes to the places of
the peaks. One row in ``VALIDATION`` is kept aside; every ``LOOK`` steps its loss is measured, the best weights are kept,
and fitting ends after ``PATIENCE`` looks without one that is better by ``BETTER``. The driver holds those rows' texts. The output is shifted
to the classes' shares among all labelled rows. Scoring covers every byte of every text. Labels, language, source and id
are never inputs.

A null or empty text is one chunk of zero bytes and gets a score too. Rows with a null label are not used; a
repeated id counts each time. Without both classes the score is the share of label 1, or 0.5 without labels.
An empty table gives an empty result. Other columns are carried whatever their names; ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import spread
from .common import carried, table, through_python

WIDTH, FILTERS, EMBEDDING, HIDDEN = 6, 24, 8, 16
CHUNK = 256
STEP = CHUNK // 2
PER_CLASS = 1500
STEPS, BATCH, RATE = 400, 32, 0.01
VALIDATION, LOOK, PATIENCE, BETTER = 8, 25, 3, 0.002
THRESHOLD = 0.7
#: Bytes scored at once.
PIECE = STEP * 256


@dataclass
class Network:
    """``tables`` fold embedding and filters; ``share`` is set instead where nothing could be learned."""

    tables: np.ndarray | None = None
    bias: np.ndarray | None = None
    dense: tuple = ()
    share: float | None = None

    def chunk_vectors(self, text: bytes) -> np.ndarray:
        """The pooled filters of every chunk."""
        peaks, _ = _peaks(self.tables, _padded(text), places=False)
        pooled = np.maximum(peaks[:-1], peaks[1:]) if len(peaks) > 1 else peaks
        return np.maximum(pooled + self.bias, 0)

    def score(self, text: bytes) -> float:
        if self.share is not None:
            return self.share
        v = self.chunk_vectors(text)
        w1, b1, w2, b2 = self.dense
        h = np.maximum(np.concatenate([v.mean(axis=0), v.max(axis=0)]) @ w1 + b1, 0)
        return float(1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))))


def _padded(text: bytes) -> np.ndarray:
    """The bytes with zeros up to whole steps, and those that the last filters see beyond."""
    whole = np.zeros(max(1, -(-len(text) // STEP)) * STEP + WIDTH - 1, np.uint8)
    whole[: len(text)] = np.frombuffer(text, np.uint8)
    return whole


def _peaks(tables: np.ndarray, whole: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Per step of ``STEP`` bytes and filter the highest output and, if asked for, where it is."""
    steps = len(whole) // STEP
    peaks = np.empty((steps, FILTERS), tables.dtype)
    where = np.empty((steps, FILTERS), np.int64) if places else None
    for at in range(0, steps * STEP, PIECE):
        end = min(at + PIECE, steps * STEP)
        piece = whole[at : end + WIDTH - 1].astype(np.intp)
        out = tables[0].take(piece[: end - at], axis=0)
        for j in range(1, WIDTH):
            out += tables[j].take(piece[j : end - at + j], axis=0)
        out = out.reshape(-1, STEP, FILTERS)
        own = slice(at // STEP, end // STEP)
        if places:
            # Filters last is how the outputs lie; an argmax along the steps is faster on rows.
            rows = np.ascontiguousarray(out.transpose(0, 2, 1))
            best = rows.argmax(axis=2)
            peaks[own] = np.take_along_axis(rows, best[:, :, None], axis=2)[:, :, 0]
            where[own] = best + (np.arange(at, end, STEP))[:, None]
        else:
            peaks[own] = out.max(axis=1)
    return peaks, where


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _start(seed: int, kind=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(kind)
    return {
        "e": normal(0.5, 256, EMBEDDING), "k": normal(1 / np.sqrt(WIDTH * EMBEDDING), WIDTH, EMBEDDING, FILTERS), "b": np.zeros(FILTERS, kind),
        "w1": normal(1 / np.sqrt(2 * FILTERS), 2 * FILTERS, HIDDEN), "b1": np.zeros(HIDDEN, kind), "w2": normal(1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros((), kind),
    }


def _gradients(p: dict[str, np.ndarray], texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, backwards: bool = True) -> tuple[float, dict]:
    """The mean weighted loss of some padded texts, and its gradient."""
    tables = np.einsum("be,wef->wbf", p["e"], p["k"])
    n = len(texts)
    features, saved = np.empty((n, 2 * FILTERS), tables.dtype), []
    # All texts in one array, parted by a step of zeros, as each ends in them.
    gap = np.zeros(STEP, np.uint8)
    joined = np.concatenate([x for whole in texts for x in (whole[: -(WIDTH - 1)], gap)] + [gap[: WIDTH - 1]])
    every_peak, every_place = _peaks(tables, joined, places=backwards)
    at = 0
    for i, whole in enumerate(texts):
        own = slice(at, at + len(whole) // STEP)
        peaks, where = every_peak[own], every_place[own] if backwards else None
        at = own.stop + 1
        if len(peaks) > 1:  # a chunk is a step and the next
            second = peaks[1:] > peaks[:-1]
            chunk = np.where(second, peaks[1:], peaks[:-1])
            where = np.where(second, where[1:], where[:-1]) if backwards else None
        else:
            chunk = peaks
        chunk = chunk + p["b"]
        c = np.maximum(chunk, 0)
        features[i, :FILTERS], features[i, FILTERS:] = c.mean(axis=0), c.max(axis=0)
        if backwards:
            saved.append((chunk > 0, c == features[i, FILTERS:], where))
    h = np.maximum(features @ p["w1"] + p["b1"], 0)
    z = np.clip(h @ p["w2"] + p["b2"], -30, 30)
    loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
    if not backwards:
        return loss, {}
    g = (weight * (1 / (1 + np.exp(-z)) - y) / n).astype(tables.dtype)
    dh = np.outer(g, p["w2"]) * (h > 0)
    df = dh @ p["w1"].T
    dc = [(df[i, :FILTERS] / len(on) + df[i, FILTERS:] * top / top.sum(axis=0)) * on for i, (on, top, _) in enumerate(saved)]
    dc, where = np.concatenate(dc), np.concatenate([w for *_, w in saved])
    filters, dt = np.arange(FILTERS), np.empty_like(tables)
    for j in range(WIDTH):
        cell = joined[where + j].astype(np.intp) * FILTERS + filters
        dt[j] = np.bincount(cell.ravel(), dc.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return loss, {
        "e": np.einsum("wbf,wef->be", dt, p["k"]), "k": np.einsum("wbf,be->wef", dt, p["e"]), "b": dc.sum(axis=0),
        "w1": features.T @ dh, "b1": dh.sum(axis=0), "w2": h.T @ g, "b2": g.sum(),
    }


def _descent(texts: list[bytes], y: np.ndarray, seed: int, steps: int) -> tuple:
    """Adam on the mean loss, both classes weighing the same."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    p = _start(seed)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    weight = (0.5 / np.where(y == 1, y.mean(), 1 - y.mean())).astype(np.float32)
    padded = [_padded(t) for t in texts]
    aside = np.arange(len(y)) % VALIDATION == VALIDATION - 1
    learn, watch = np.flatnonzero(~aside), np.flatnonzero(aside)
    best, kept, worse, t = np.inf, p, 0, 0
    while t < steps and worse < PATIENCE:
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            _, grad = _gradients(p, [padded[r] for r in rows], y[rows], weight[rows])
            t += 1
            rate = RATE * max(0.02, 1 - t / steps)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
            if t % LOOK == 0 or t == steps:
                loss = _gradients(p, [padded[r] for r in watch], y[watch], weight[watch], backwards=False)[0] if len(watch) else -t
                if loss < best - BETTER:
                    best, kept, worse = loss, {k: x.copy() for k, x in p.items()}, 0
                else:
                    worse += 1
            if t >= steps or worse >= PATIENCE:
                break
    return np.einsum("be,wef->wbf", kept["e"], kept["k"]).astype(np.float32), kept["b"], (kept["w1"], kept["b1"], kept["w2"], float(kept["b2"]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = STEPS, seed: int = 7) -> Network:
    """From ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label`` of 0 or 1)."""
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    n = dict(labels.groupBy("label").count().collect())
    if not (n.get(0) and n.get(1)):
        return Network(share=0.5 if not n else float(n.get(1, 0) > 0))
    pick = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    some = [labels.where(F.col("label") == k).orderBy(pick, "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body")).join(F.broadcast(some[0].union(some[1])), "doc_id")
    # Repeated ids may have more texts than rows were picked.
    got = rows.select("doc_id", "label", "body").orderBy(pick, "label", F.md5("body")).limit(2 * per_class).collect()
    got.sort(key=lambda r: (r.doc_id, r.label, bytes(r.body or b"")))
    y = np.array([r.label for r in got], np.float32)
    if not 0 < y.sum() < len(y):
        return Network(share=n[1] / (n[0] + n[1]))
    tables, bias, (w1, b1, w2, b2) = _descent([bytes(r.body or b"") for r in got], y, seed, steps)
    return Network(tables, bias, (w1, b1, w2, b2 + float(np.log(n[1] / n[0]))))


def _score(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [network.score(x.as_py() or b"") for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), *batch.columns[1:]], names=batch.schema.names)


def scored(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``score``."""
    run = partial(_score, network=network)
    out, others = through_python(spread(docs), text, "binary", lambda b: run(b), "double")
    return out.select(*carried(others, "score"), F.col("value").alias("score"))


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: learned from labels outside the held-out quarter, scored for every row."""
    learn = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    network = fit(docs, learn)
    d = scored(docs.select("doc_id", "text"), network)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
