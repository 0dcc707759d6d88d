import html
import random

from sediment.llm import html_text as H

WORDS = ["alpha", "béta", "<tag>", "a&b", "x < y", "ßü", "one", "two", '"q"', "&amp;", "😀"]


def words(rng, n=4):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, n)))


def written(rng, s):
    """A text as markup: references, inline tags, white space of any kind, hidden matter."""
    out = []
    for w in s.split(" "):
        w = html.escape(w) if rng.random() < 0.7 else "".join(f"&#{ord(c)};" for c in w)
        if rng.random() < 0.2:
            w = f"<b>{w}</b>" if rng.random() < 0.5 else f"<span class='x'>{w}</SPAN>"
        if rng.random() < 0.15:
            w += rng.choice(["<!-- > hidden -->", "<span hidden>no</span>", "<i style='display:none'>no</i>", "<script>if (a<b) '</p>'</script>"])
        out.append(w)
    return rng.choice([" ", "\n", "\t \n"]).join(out)


def block(rng):
    """(markup, expected lines) of one block, end tags left out where they are implied."""
    end = lambda tag: f"</{tag}>" if rng.random() < 0.5 else ""
    kind = rng.choice(["p", "h2", "ul", "ol", "table", "pre"])
    if kind == "p":
        t = words(rng, 8)
        return f"<p>{written(rng, t)}{end('p')}", [t]
    if kind == "h2":
        t = words(rng)
        return f"<h2>{written(rng, t)}</h2>", [t]
    if kind in ("ul", "ol"):
        items = [words(rng) for _ in range(rng.randint(1, 4))]
        marks = [f"{i + 1}. " if kind == "ol" else "- " for i in range(len(items))]
        return f"<{kind}>" + "\n".join(f"<li>{written(rng, t)}{end('li')}" for t in items) + f"</{kind}>", [m + t for m, t in zip(marks, items)]
    if kind == "pre":
        return "<pre>\n" + html.escape("a\n   b <c>\n\td") + "</pre>", ["a", "   b <c>", "\td"]
    n = rng.randint(1, 3)
    rows = [[words(rng, 2) for _ in range(n)] for _ in range(rng.randint(1, 3))]
    width = [max(len(r[k]) for r in rows) for k in range(n)]
    cell = rng.choice(["td", "th"])
    body = "".join("<tr>" + "".join(f"<{cell}>{written(rng, t)}{end(cell)}" for t in r) + end("tr") for r in rows)
    return f"<table>{body}</table>", [" | ".join(t.ljust(w) for t, w in zip(r, width)).rstrip() for r in rows]


def page(rng):
    blocks = [block(rng) for _ in range(rng.randint(1, 8))]
    head = "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>" if rng.random() < 0.5 else ""
    return head + "".join(m for m, _ in blocks), "\n\n".join("\n".join(lines) for _, lines in blocks)


def test_round_trip():
    rng = random.Random(12)
    for _ in range(400):
        markup, want = page(rng)
        assert H.extract(markup) == want, markup


def test_implied_tags_and_recovery():
    assert H.extract("a</br>b") == "a\nb"
    assert H.extract("<p>a<div>b") == "a\n\nb"
    assert H.extract("<b>a</i>b</b> c < d <3") == "ab c < d <3"
    assert H.extract("<ul><li>a<ul><li>b</ul><li>c</ul>") == "- a\n  - b\n- c"
    assert H.extract("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>") == "a b | c | d"
    assert H.extract("<a href='x>y'>z</a> <img alt='no'><p>q") == "z\n\nq"
    assert H.extract('<a href="no end>text</a>') == "text"
    assert H.extract("x<script>never closed <p>y") == "x"
    assert H.extract("<td colspan=9999999>a<td>b") == "a\nb"
    assert H.extract("<p hidden>a<p>b<textarea>\n c\n d</textarea>") == "b c\n d"


def test_long_pages_take_linear_time():
    for s in ("<div>" * 40000 + "x", '<a href="' * 20000, "<li>" * 20000, "<" * 100000, "<table>" * 2000, "<a b='" * 20000, "<!--" * 20000, "&lt" * 40000):
        H.extract(s)


def test_query(spark):
    rng = random.Random(3)
    pages = [page(rng) for _ in range(40)]
    rows = [(i, "u", m) for i, (m, _) in enumerate(pages)] + [(100, None, None), (101, "u", ""), (None, "u", "just text"), (3, "u", pages[3][0])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.op8_html_text(d).collect()
    want = [(i, t) for i, (_, t) in enumerate(pages)] + [(100, ""), (101, ""), (None, "just text"), (3, pages[3][1])]
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    out = H.extracted(d.withColumnRenamed("url", "text"))
    assert out.columns == ["page_id", "text"]
    assert H.op8_html_text(d.limit(0)).collect() == []
