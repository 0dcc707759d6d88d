"""The pipeline's near-dedup stage: its own threshold, and rows that share an id."""

import random

import corpus_pipeline
import pytest
from sediment.llm import minhash as M

from .test_minhash import shingle_set

SCHEMA = "doc_id long, text string"


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def components(rows, percent):
    """Per row the least id that it is linked to, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    low = [d for d, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def edited(seed=5, groups=60):
    """Pairs of texts, most of them of likeness 0.75 to 0.9."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        w = [f"g{g}x{i}" for i in range(rng.randint(90, 140))]
        v = list(w)
        for at in rng.sample(range(5, len(w) - 5, 6), rng.randint(1, 4)):
            v[at] = f"n{g}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    return rows


def test_stage_links_at_eighty_and_the_query_at_eighty_five(spark):
    rows = edited()
    between = [g for g in range(0, len(rows), 2) if 0.8 <= likeness(*(shingle_set(t) for _, t in rows[g : g + 2])) < 0.85]
    assert len(between) > 5
    d = spark.createDataFrame(rows, SCHEMA)
    want = components(rows, 80)
    assert want != components(rows, 85)
    assert {r.doc_id: r.component_id for r in M.linked(d, 80).collect()} == dict(zip(dict(rows), want))
    assert {r.doc_id: r.component_id for r in M.op2_near_dedup(d).collect()} == dict(zip(dict(rows), components(rows, 85)))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, d, "").collect()}
    assert kept == {i for i, c in zip(dict(rows), want) if i == c}


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_miss_no_pair_at_the_threshold(percent):
    n, rows = M.layout(percent)
    assert n * rows == M.PERMUTATIONS and (1 - (percent / 100) ** rows) ** n < 1e-6


def test_a_text_without_copy_stays_though_its_id_has_one(spark):
    copied, clean = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, copied, "x"), (2, copied + " end", "y"), (2, clean, "y"), (2, clean, "y"), (3, None, "z"), (3, "", "z"), (None, copied, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra string").withColumnRenamed("extra", "extra kept")
    out = M.deduplicated(d)
    assert out.columns == d.columns and out.schema["doc_id"].dataType == d.schema["doc_id"].dataType
    want = [(1, copied, "x"), (2, clean, "y"), (3, None, "z"), (3, "", "z"), (None, copied, "n")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
