"""Operators of built-in expressions on rows that the tables don't have: nulls, repeats, ties, long texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm import chat_format as C
from sediment.llm import fingerprint as P
from sediment.llm import quality_rules as Q

CUT = re.compile(rf"(?<={P.ENDS}) (?={P.BEGINS})")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    """(root, sections of paragraphs of leaves), by one walk over the text."""
    sections, fresh = [], True
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    for i, p in enumerate(lines):
        leaves = [sha(x)[:32] for x in CUT.split(p)]
        if fresh:
            sections.append([])
        sections[-1].append(tuple(leaves))
        blank_next = i + 1 < len(lines) and lines[i + 1] == "\n"
        fresh = not blank_next and (p == "\n" or sha("P" + ",".join(leaves))[0] in "0123")
    nodes = [sha("S" + "".join(sha("P" + ",".join(p)) for p in s)) for s in sections]
    return sha("R" + "".join(nodes)), sections


def outside(a, b):
    """What is left of two lists without their common beginning and, after that, their common end."""
    a, b, k = list(a), list(b), 0
    while a and b and a[0] == b[0]:
        a.pop(0), b.pop(0)
        k += 1
    while a and b and a[-1] == b[-1]:
        a.pop(), b.pop()
    return a, b, k


def compared(a, b):
    """(removed, added, likeness, places of the removed, places of the added)."""
    if a[0] == b[0]:
        return 0, 0, 1.0, [], []
    x, y, k = outside(a[1], b[1])
    before = sum(map(len, a[1][:k]))
    p, q, k = outside([z for s in x for z in s], [z for s in y for z in s])
    gone, came = [z for z in dict.fromkeys(p) if z not in q], [z for z in dict.fromkeys(q) if z not in p]
    went, new = {z for t in gone for z in t}, {z for t in came for z in t}
    n = sum(len({z for s in t[1] for r in s for z in r}) for t in (a, b))
    at = lambda own, other: [before + k + i for i, z in enumerate(own) if z not in other]
    return max(len(gone), len(p) - len(q)), max(len(came), len(q) - len(p)), 1 - max(len(went ^ new), 1) / n, at(p, q), at(q, p)


def brute(rows):
    order = sorted(((d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for d, t in rows))
    out = []
    for k, (null, d, _, t) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = tree(t), tree(edited), tree(following)
        e = compared(a, b)
        out.append((None if null else d, len(t), sha(edited), a[0], b[0], e[2], compared(a, c)[2], len(a[1]), sum(map(len, a[1])), *e[:2]))
    return out


def texts(n=300):
    rng = random.Random(17)
    words = ["one", "zwei", "trois", "😀", "ñ", "a.", "\n", "\n\n", " ", "\t", "\n\n\n", "word", "\r\n"]
    return ["".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.choice([0, 1, 5, 40, 120]))) for _ in range(n)]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([i, i * 1000, -i, 10**12 + i]), t) for i, t in enumerate(texts())]
    rows += [(5, None), (5, ""), (5, "same"), (5, "same"), (None, "no id"), (None, None), (7, "x y " * 50000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = [tuple(r) for r in P.op1_fingerprint(d).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_fingerprints_of_few_rows(spark):
    for rows in ([(3, "only one row here")], [(1, None)], [(None, "a")], [(1, "a b\n\nc d"), (2, "a b\n\nc d")]):
        got = [tuple(r) for r in P.op1_fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert P.op1_fingerprint(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_far_apart_share_no_range(spark):
    rows = [(i if i < 900 else i * 10**9, f"text {i}") for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.next_body for r in P.with_next(d, {"body": F.col("text")}).collect()}
    ids = [i for i, _ in rows]
    assert got == {a: dict(rows)[b] for a, b in zip(ids, ids[1:] + ids[:1])}


def test_ids_that_many_rows_share_are_split(spark):
    rng = random.Random(12)
    words = lambda: " ".join(rng.choice(["the", "river", "house", "night", "of"]) for _ in range(rng.randint(1, 9)))
    rows = [(None, words()) for _ in range(400)] + [(77, words()) for _ in range(400)] + [(i, words()) for i in range(0, 400)] + [(77, "same")] * 20
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    place, tie = P._ranges(d)
    counts = {(r.i, r.p): r["count"] for r in d.select(F.col("doc_id").alias("i"), place.alias("p")).groupBy("i", "p").count().collect()}
    assert max(n for (i, _), n in counts.items() if i is None) < 20 and len([1 for i, _ in counts if i == 77]) > 50
    got = [tuple(r) for r in P.op1_fingerprint(d).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def edits(spark, pairs):
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    d = d.select("i", P.tree("a").alias("a"), P.tree("b").alias("b"))
    return [tuple(r.e) for r in d.select("i", P.compared("a", "b").alias("e")).orderBy("i").collect()]


def test_differing_branches_locate_edits(spark):
    rng = random.Random(4)
    lines = [f"line {i} has " + " ".join(rng.choice(["some", "of", "these", "words", "and", "to"]) for _ in range(12)) + "\n" for i in range(40)]
    whole = "".join(lines)
    cases = {
        "insert": lines[:11] + ["a new one\n"] + lines[11:], "top": ["a new one\n"] + lines, "delete": lines[:20] + lines[22:], "change": lines[:5] + ["other\n"] + lines[6:],
        "twice": lines[:8] + [lines[7]] + lines[8:], "move": lines[1:] + lines[:1], "append": lines + ["end"], "word": [x.replace("line 9 has", "line 9 now has") for x in lines],
    }
    got = dict(zip(cases, edits(spark, [(whole, "".join(c)) for c in cases.values()])))
    place = lambda k: (got[k][0], got[k][1], got[k][3], got[k][4])
    assert place("insert") == (0, 1, [], [11]) and place("top") == (0, 1, [], [0]) and place("delete") == (2, 0, [20, 21], [])
    assert place("change") == (1, 1, [5], [5]) and place("word") == (1, 1, [9], [9]) and place("append") == (0, 1, [], [40])
    assert place("twice") == (0, 1, [], [8]) and place("move") == (0, 0, [], [])
    assert all(0.9 < e[2] < 1 for e in got.values()) and got["word"][2] > 0.97
    assert len(tree(whole)[1]) > 4  # without a blank line


def test_edits_match_brute_force(spark):
    rng = random.Random(9)
    pairs = []
    for t in texts(120):
        lines = re.findall(r"[^\n]*\n|[^\n]+", t * 2)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(lines) + 1)
            kind = rng.choice(["in", "out", "swap", "copy"])
            if kind == "in":
                lines.insert(k, rng.choice(["new line\n", "\n", "word of it "]))
            elif lines and kind == "out":
                lines.pop(k % len(lines))
            elif lines and kind == "swap":
                lines.append(lines.pop(k % len(lines)))
            elif lines:
                lines.insert(k, lines[k % len(lines)])
        pairs.append((t * 2, "".join(lines)))
    pairs += [("", ""), ("", "a b"), ("x x x x", ""), ("a i a i a", "a i a")]
    for (a, b), got in zip(pairs, edits(spark, pairs), strict=True):
        assert got == compared(tree(a), tree(b)), (a, b)


def test_one_word_more_costs_little(spark):
    rng = random.Random(3)
    bits = ["an", "be", "cor", "del", "est", "ing", "mo", "ter", "um", "vi"]
    vocab = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(20)]
    assert all(e[2] > 0.9 for e in edits(spark, [(t, "first " + t) for t in rows]))
    assert all(e[2] < 0.3 for e in edits(spark, list(zip(rows, rows[1:]))))


def test_fingerprinted_replaces_its_columns(spark):
    d = spark.createDataFrame([(1, "a b", 2, "t"), (2, None, 3, "t")], "id long, text string, fingerprint int, tree string")
    rows = P.fingerprinted(d).collect()
    assert [r.fingerprint for r in rows] == [tree("a b")[0], tree("")[0]] and rows[0].tree.root == rows[0].fingerprint and "text" in P.fingerprinted(d).columns


def test_quality_rules_on_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "the word of it " * 9, 5), (3, " \n\t", 5), (4, "x" * 100_000, 5), (5, "the cat and " * 4000, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = Q.op6_quality_rules(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[1].symbol_ratio == 0
    assert by[4].n_words == 1 and by[4].word_chars == 100_000 and by[5].n_repeat_words == 12_000
    assert Q.filtered(d).columns == d.columns and Q.filtered(d).collect() == []
    assert Q.op6_quality_rules(d.limit(0)).collect() == []


def turns():
    rng = random.Random(6)
    bits = ["<|turn|>", "<|end|>", "&lt;", "&amp;lt;", "[INST]", "</s>", "a\nb", "😀", "", "&#91;", "user\n", "x" * 50]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "to<ol\n"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6)))))
    return rows + [(None, 0, "user", "n"), (None, 1, "assistant", None), (100, None, None, "x"), (100, 0, "assistant", "y"), (101, 0, "user", "t"), (101, 0, "user", "t"), (102, 0, "assistant", "long " * 40000)]


def test_chat_is_read_back(spark):
    rows = turns()
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.op7_chat_format(d).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, ts in convs.items():
        ts.sort(key=lambda x: (*x[:3], x[3].replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")))
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for *_, r, t in ts))
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert C.op7_chat_format(d.limit(0)).collect() == []


def test_a_wrong_mask_is_an_error(spark):
    rows = [(1, 0, "user", "hé <b> 😀"), (1, 1, "assistant", "yes & 😀 no"), (1, 2, "user", "x"), (1, 3, "assistant", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = C.formatted(d.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))
    assert C.read_back(c).first().loss_text == "yes & 😀 no"
    for off, more in ((7, 0), (-1, 0), (0, 1), (0, -1)):
        moved = F.transform("loss_mask", lambda m: F.struct((m["start"] + off).alias("start"), (m["length"] + more).alias("length")))
        with pytest.raises(Exception, match="loss mask is not that of the text"):
            C.read_back(c.withColumn("loss_mask", moved)).select("loss_text").collect()
    with pytest.raises(Exception, match="loss mask is not that of the text"):
        C.read_back(c.withColumn("loss_mask", F.slice("loss_mask", 1, 1))).select("loss_text").collect()


def test_mask_and_control_strings(spark):
    d = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string")
    for r in C.formatted(d.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts"))).collect():
        bodies = [m.group(1) for m in re.finditer(r"<\|turn\|>assistant\n(.*?)<\|end\|>", r.formatted, re.S)]
        assert [r.formatted[m.start : m.start + m.length] for m in r.loss_mask] == bodies
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") and "[INST]" not in r.formatted and "</s>" not in r.formatted


def test_parts_become_placeholders(spark):
    part = lambda type, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (type, text, ref, width, height, seconds, pages)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=57, height=28), part(None, " & <hear>"), part("audio", ref="b.wav", seconds=1.5), part("document", pages=3), part("image"), None]),
        (1, 1, "assistant", [part("other", "ok")]), (1, 2, "user", None), (1, 3, "user", []),
    ]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T._parse_datatype_string(C.PARTS))])
    r = C.formatted(spark.createDataFrame(rows, schema)).first()
    assert r.formatted.startswith("<|turn|>user\nsee <|image:1|> &amp; &lt;hear><|audio:3|><|document:4|><|image:5|><|end|><|turn|>assistant\nok<|end|>")
    assert [(a.turn, a.part.part, a.part.type, a.part.ref, a.part.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 3), (0, 3, "audio", "b.wav", 38), (0, 4, "document", None, 768), (0, 5, "image", None, 1)]
    assert r.expanded_tokens == 810
