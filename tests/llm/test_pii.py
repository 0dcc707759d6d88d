import hashlib
import random
import re
from collections import Counter

import numpy as np

from sediment.llm import pii as P

from .pii_sentences import sentences

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += sum(map(int, str(n)))
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and plain_luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(8)
    alphabet = "ab.@@+-_%1234567890 ().é\n"
    bits = ["a.b+c@d-e.f.g", "x@y", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (984) 555-5227", "+49.30.123", "+1 2", "4917610000000000003", "a@b.c+d@e.f", "12345678901234567890123", "😀 é"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    rows += [rng.choice(["", " ", "x"]).join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return rows


def test_base_spans_match_the_plain_patterns():
    for t in texts():
        assert P.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+" * 100_000, "@" * 100_000, "1 " * 100_000, "+1" + " " * 200_000, "a@b." * 50_000, "AB12" * 60_000):
        P.base_spans(t)
        P.candidates(t)


def test_query(spark):
    rows = list(enumerate(texts())) + [(9000, None), (9001, ""), (None, "a@b.cd"), (9002, "call 1"), (9002, "call 1")]
    got = P.op4_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = []
    for d, t in rows:
        b = brute(t)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append((d, *[sum(x[0] == k for x in b) for k in P.BASE], hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] in P.BASE] == [[k, str(a), str(b)] for k, a, b in brute(dict(rows)[r.doc_id] if r.doc_id is not None else "a@b.cd")]


def test_trees_and_thresholds():
    x, y, kinds = P.training_rows(3000, seed=99)
    trees, limits = P.model()
    p = trees(x)
    picked = p >= np.array([limits[k] for k in kinds])
    assert y[picked].mean() > 0.95 and picked[y == 1].mean() > 0.85
    assert abs(p.mean() - y.mean()) < 0.05


def test_recall_and_precision_on_another_grammar():
    trees, limits = P.model()
    rows = sentences(3000)
    hit, missed, false = Counter(), Counter(), Counter()
    for (text, items), spans in zip(rows, P.find_spans([t for t, _ in rows], trees, limits)):
        got = [(k, text[a:b]) for k, a, b, _ in spans if k in P.ADDED]
        hit.update(k for k, x in items if (k, x) in got)
        missed.update(k for k, x in items if (k, x) not in got)
        false.update(k for k, x in got if (k, x) not in items)
    for k in P.ADDED:
        assert hit[k] > 50 and hit[k] / (hit[k] + missed[k]) >= 0.9, (k, "recall")
        assert hit[k] / (hit[k] + false[k]) >= 0.9, (k, "precision")


def test_kinds_and_dates_are_told_apart():
    trees, limits = P.model()
    said = lambda t: [(k, t[a:b]) for k, a, b, _ in P.find_spans([t], trees, limits)[0]]
    assert said("SSN 123-45-6789") == [("ssn", "123-45-6789")] and said("my mobile is 5551234567") == [("phone_local", "5551234567")]
    assert said("tel 0171 2345678") == [("phone_local", "0171 2345678")]
    for text in ("call 2021-03-04", "call on 04.03.2021 please", "phone bill of 12/11/2019", "on 2021-03-04"):
        assert said(text) == [], text


def test_added_spans_match_a_plain_choice():
    # All candidates by every start and end, scored one by one; the likeliest of overlapping ones stays.
    trees, limits = P.model()
    for text, _ in sentences(300, seed=5):
        base = P.base_spans(text)
        every = [(float(trees(np.array([P.features(text, k, a, b)]))[0]), k, a, b) for k, a, b in P.candidates(text)]
        kept = []
        for p, k, a, b in sorted(every, key=lambda c: (-c[0], c[2], c[3])):
            if p >= limits[k] and all(b <= s or a >= e for _, s, e in base + kept):
                kept.append((k, a, b))
        got = P.find_spans([text], trees, limits)[0]
        assert sorted((k, a, b) for k, a, b, _ in got) == sorted(base + kept)


def test_clashing_columns(spark):
    d = spark.createDataFrame([("mail a@b.cd", 1, 2, 3, 4, "x")], "text string, spans int, __text int, value int, c0 int, `a.b` string")
    assert P.found(d).columns == ["__text", "value", "c0", "a.b", "spans"] and tuple(P.found(d).first())[:4] == (2, 3, 4, "x")
    assert P.redacted(d).columns == d.columns and tuple(P.redacted(d).first()) == ("mail <EMAIL>", 1, 2, 3, 4, "x")


def test_added_spans_and_redaction(spark):
    rows = [(1, "call phone: (555) 123-4567 today", "k"), (2, "on 2021-03-04 page 12 34", "k"), (3, "mail jane.doe (at) example (dot) com or a@b.cd", "k"), (4, None, None), (5, "nothing here", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = P.redacted(d)
    assert out.columns == d.columns
    t = {r.doc_id: r.text for r in out.collect()}
    assert t == {1: "call phone: <PHONE> today", 2: rows[1][1], 3: "mail <EMAIL> or <EMAIL>", 4: None, 5: "nothing here"}
    assert P.op4_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
