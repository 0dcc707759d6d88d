"""Packing documents into sequences by order-preserving dynamic programming.

Each partition's documents form one stream of tokens, in input order, every document closed by ``END_ID``.
Windows of at most ``length`` tokens cover the stream; where they are cut is chosen to minimise

    padding (none for a window whose size is a power of two) + ``WINDOW_COST`` a window
    + ``SENTENCE_COST`` a cut between sentences + ``HARD_COST`` a cut inside a sentence

Cuts at document ends are free. Sentences longer than ``LONG`` tokens may be cut every ``STEP`` tokens, the
last ``length`` tokens of a partition anywhere, so that its rest can fall into windows of powers of two.
With cost(i, j) = length - (p_j - p_i) the best start of a window that ends at j is a minimum of
f(i) + p_i over a sliding range of positions: a monotone queue keeps it, so a stream of n cut places
takes O(n) steps (and one look-up per power of two).

The stream is worked off in blocks of about ``BLOCK`` tokens; the last window of a block opens the next.
Memory is bounded by a block, or by one document. Nothing is shuffled. A sequence's id is made of its
partition and its place there, so a task that is run again gives the same rows.

A null or empty text is the one token ``END_ID``; ids of any type, null ones too, are carried; equal rows are packed
each; other columns are left out, whatever their names; an empty table gives no sequence.

Token ids are those of the ``tokenizers`` library with the given vocabulary file. They are made with
``tiktoken`` from the same vocabulary as ranks, which is three times as fast. Every text whose checksum is 0 modulo
``CHECKED``, of whatever length, is encoded with ``tokenizers`` as well, and a difference is an error.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches

LENGTH = 2048
END_ID = 1
WINDOW_COST = 2
SENTENCE_COST = 6
HARD_COST = 24
LONG, STEP = 256, 64
BLOCK = 1 << 18
#: Bits of a sequence id that number a partition's sequences.
PLACE_BITS = 34

#: One in so many texts is encoded a second time, with ``tokenizers``.
CHECKED = 16

SCHEMA = "start long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Encoder:
    """Ids of texts as numpy arrays."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special}
        self.special = set(special)
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        self.ends = np.zeros(self.model.get_vocab_size() + 1, bool)
        for token, i in table.items():
            self.ends[i] = b"\n" in token or token.rstrip()[-1:] in (b".", b"!", b"?")

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype(np.uint32, copy=False)


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None, ranks: str | None) -> Encoder:
    import public_tokenizers as files

    return Encoder(vocabulary or files.path("byte_bpe_50k.json"), ranks or files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def cut_places(lengths: list[int], ends: np.ndarray, free_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, 0 and its end included, and what a cut there costs.

    ``lengths`` are those of its segments, ``ends`` marks tokens that end a sentence; from ``free_from`` on
    every place will do.
    """
    total = len(ends)
    cost = np.full(total + 1, -1, np.int64)
    cost[1:][ends] = SENTENCE_COST
    cost[free_from:][cost[free_from:] < 0] = HARD_COST
    cost[np.cumsum([0, *lengths])] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    for k in np.flatnonzero(gap > LONG):
        cost[at[k] + STEP : at[k + 1] : STEP] = HARD_COST
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """The places of the cheapest cover by windows, first and last included. Gaps are at most ``length``."""
    p, c = at.tolist(), cost.tolist()
    n = len(p)
    index = {x: i for i, x in enumerate(p)}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    f, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # places with rising f + p: its head starts the best window
    g = [0] * n
    get = index.get
    for j in range(1, n):
        here = p[j]
        low = here - length
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = g[i] + length - here
        for w in powers:
            if w > here:
                break
            k = get(here - w)
            if k is not None and f[k] < best:
                best, i = f[k], k
        f[j] = best + c[j] + WINDOW_COST
        back[j] = i
        g[j] = mine = f[j] + here
        while queue and g[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    out, j = [p[-1]], n - 1
    while j:
        j = back[j]
        out.append(p[j])
    return out[::-1]


class _Stream:
    """Packs the segments (doc_id, start, ids, doc_tokens) of one partition."""

    def __init__(self, ends: np.ndarray, length: int, first_id: int, id_type: pa.DataType):
        self.ends, self.length, self.next_id, self.id_type = ends, length, first_id, id_type
        self.segments: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.segments.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Rows of all windows but, unless it is the last flush, the last one, which is kept."""
        segments = self.segments
        if not segments:
            return None
        ids = np.concatenate([s[2] for s in segments])
        at, cost = cut_places([len(s[2]) for s in segments], self.ends[ids], max(1, len(ids) - self.length) if last else len(ids))
        cuts = best_cuts(at, cost, self.length)
        stop = cuts[-1] if last else cuts[-2]
        rows: list[tuple] = []
        k = base = 0  # the segment that the window begins in, and where it begins in the stream
        for a, b in zip(cuts, cuts[1:]):
            if b > stop:
                break
            x = a
            while x < b:
                doc_id, start, own, total = segments[k]
                y = min(b, base + len(own))
                rows.append((doc_id, start + x - base, own[x - base : y - base].astype("<u4").tobytes(), total, self.next_id, x - a, b - a))
                x = y
                if y == base + len(own):
                    base, k = y, k + 1
            self.next_id += 1
        rest = segments[k:]
        if rest:
            doc_id, start, own, total = rest[0]
            rest[0] = (doc_id, start + stop - base, own[stop - base :], total)
        self.segments, self.tokens = rest, len(ids) - stop
        if not rows:
            return None
        kinds = (self.id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=list(names))


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str | None, ranks: str | None, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, ranks)
    end = np.array([end_id], np.uint32)
    stream = None
    for batch in batches:
        stream = stream or _Stream(encode.ends, length, TaskContext.get().partitionId() << PLACE_BITS, batch.schema.field(0).type)
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            ids = encode(text)
            if zlib.crc32(text.encode()) % CHECKED == 0 and not np.array_equal(ids, encode.slow(text)):
                raise ValueError(f"tokenizers and tiktoken differ on document {doc_id.as_py()}")
            stream.add(doc_id.as_py(), np.concatenate([ids, end]))
            if stream.tokens >= BLOCK and (out := stream.flush(last=False)) is not None:
                yield out
    if stream and (out := stream.flush(last=True)) is not None:
        yield out


def packed(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row per piece, with its ids as little-endian 32-bit numbers. The vocabulary (for ``tokenizers``) and
    its ranks are paths that every executor can read; None names the public byte-level BPE of 50k ids."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string"))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(SCHEMA).fields])
    run = partial(_packed, vocabulary=vocabulary, ranks=ranks, length=length, end_id=end_id)
    return rows.mapInArrow(lambda batches: run(batches), schema)


def op10_packing(docs: DataFrame) -> DataFrame:
    return packed(docs).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_tokens",
    )
