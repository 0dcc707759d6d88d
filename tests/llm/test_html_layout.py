"""Visibility by declarations and rules, table grids, deep pages, and the words of real pages by another way."""

import os
import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from sediment.llm.html_text import HIDDEN, VOID, Sheet, extract

DIR = "/root/testdata/sf0.01"


def test_declarations_are_read_by_name():
    assert extract('<p style="backface-visibility:hidden">a</p><p style="x-display:none">b</p><p style="--visibility: hidden; color:red">c') == "a\n\nb\n\nc"
    assert extract('<p style="DISPLAY : None">a</p><p style="color:red;display:none ! important">b</p><p style="display:none;display:block">c') == "c"
    assert extract('<p style="display:none!important;display:block">a</p><p style="/*x*/display:/*y*/none">b</p>c') == "c"
    assert extract("<p hidden>a</p><p hidden style='display:block'>b</p><p style='visibility:collapse'>c</p>") == "b"
    assert extract("<div style='visibility:hidden'>a<p style='visibility:visible'>b <i style='visibility:hidden'>c</i> d</p>e</div>") == "b d"


def test_rules_of_style_elements():
    page = "<style>%s</style><div class='x y' id=i>one</div><p class=x>two</p><p>three"
    for css, want in {
        ".x{display:none}": "three", "p{display:none}": "one", "#i{display:none}": "two\n\nthree", "div.y.x{display:none}": "two\n\nthree", "p.y{display:none}": "one\n\ntwo\n\nthree",
        "*{visibility:hidden} p{visibility:visible}": "two\n\nthree", ".x{display:none} p.x{display:block}": "two\n\nthree", "p.x{display:none} .x{display:block}": "one\n\nthree",
        ".x{display:none!important} #i{display:block}": "three", "@media print{.x{display:none}}": "one\n\ntwo\n\nthree", "@media screen { .x { display : none } } p{margin:0}": "three",
        "@import url(a.css); .x{display:none}": "three", "/* .x{display:none} */ p,.q{display:none}": "one", "div p{display:none} p:hover{display:none} [id]{display:none}": "one\n\ntwo\n\nthree",
        "@font-face{font-family:x} .x{display:none": "three", "p{": "one\n\ntwo\n\nthree", "}}} p{display:none}": "one", "@media print{ a{b:c} .x{display:none} } p{display:none}": "one",
    }.items():
        assert extract(page % css) == want, css
    assert extract("<p class=x>a</p><p class=x style='display:block'>b</p><style>.x{display:none}</style>") == "b"


def test_object_shows_what_is_inside():
    assert extract("<object data=x><param name=y>text <b>inside</b></object> after") == "text inside after"
    assert extract("<video>no</video><canvas>no</canvas><noscript>no</noscript><iframe>no</iframe>z") == "z"


def test_cells_over_rows_and_columns():
    assert extract("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert extract("<table><tr><td>long cell<td rowspan=2>b<td>c<tr><td>d<td>e</table>") == "long cell | b | c\nd         |   | e"
    assert extract("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>") == "ab    | c\nd | e | f"
    assert extract("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"
    assert extract("<table><tr><td rowspan=3 colspan=2>x<td>1<tr><td>2<tr><td>3<tr><td>p<td>q<td>4</table>") == "x     | 1\n      | 2\n      | 3\np | q | 4"
    assert extract("<table><td>a<td>b<tr><td>c</table>") == "a | b\nc"
    assert extract("<table><tbody><td>a<th>b</tbody></table>") == "a | b"


def naive_grid(rows):
    """The lines of a table of (text, columns, rows) cells from a full matrix of owners."""
    owner, n = {}, len(rows)
    starts = []
    for r, row in enumerate(rows):
        at = 0
        for text, across, down in row:
            while (r, at) in owner:
                at += 1
            starts.append((r, at, across, text))
            for i in range(r, min(n, r + down)):
                for k in range(at, at + across):
                    owner.setdefault((i, k), text)
            at += across
    columns = sorted({at for _, at, _, _ in starts})
    width = {c: max([len(t) for _, at, across, t in starts if at == c and across == 1], default=0) for c in columns}
    lines = []
    for r in range(n):
        cells = {at: (across, t) for i, at, across, t in starts if i == r}
        out, k = "", 0
        if not any(t for _, t in cells.values()):
            continue
        while k <= max(cells):
            if k in cells:
                across, t = cells[k]
                span = [c for c in columns if k <= c < k + across]
                out += t.ljust(sum(width[c] for c in span) + 3 * (len(span) - 1)) + " | "
                k += across
            else:
                out += (" " * width[k] + " | ") if k in width else ""
                k += 1
        lines.append(out[:-3].rstrip())
    return lines


def test_grids_match_a_matrix():
    rng = random.Random(8)
    for _ in range(300):
        rows = [[(rng.choice(["a", "bb", "ccc dd", "e"]), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in rows) + "</table>"
        want = [" | ".join(p for p in line.split("\0")) for line in naive_grid(rows)]
        # Blank columns between bars look alike however they are parted.
        flat = lambda lines: [" ".join(x.replace("|", " ").split()) for x in lines]
        got = extract(page).split("\n")
        assert flat(got) == flat(want), page
        for g, w in zip(got, want):
            assert [i for i, c in enumerate(g) if c not in " |"] == [i for i, c in enumerate(w) if c not in " |"], page


def test_deep_and_long_pages_take_linear_time():
    pages = {
        "scopes": lambda n: "<p><button>" + "<div>" * n + "x", "tables": lambda n: "<table><tr><td>x" * n, "lists": lambda n: "<ul><li>x" * n, "rows": lambda n: "<table><tr><td rowspan=60000 colspan=1000>a" + "<tr><td>b" * n,
        "quotes": lambda n: "<blockquote>x" * n, "rules": lambda n: "<style>" + ".a{display:none}" * n + "</style>" + "<p class=b>x" * n, "inline": lambda n: "<b><i>" * n + "x", "media": lambda n: "<style>" + "@media x{" * n + "</style>z",
    }
    for name, page in pages.items():
        took = []
        for n in (2000, 16000):
            text = page(n)
            start = time.perf_counter()
            extract(text)
            took.append(time.perf_counter() - start)
        assert took[1] < 30 * max(took[0], 0.01), (name, took)
    start = time.perf_counter()
    extract(pages["scopes"](8000))
    assert time.perf_counter() - start < 1


class Words(HTMLParser):
    """Visible words by the standard library's tokenizer and a stack of hidden elements, without any tree or layout."""

    def __init__(self, sheet):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out, self.sheet = [], [], sheet

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        style = attrs.get("style", "").replace(" ", "").lower()
        out = tag in HIDDEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or bool(set(attrs.get("class", "").split()) & self.sheet)
        if tag in VOID:
            return
        if self.hidden or out:
            self.hidden.append(tag)
        if not self.hidden:
            self.out.append(" " if tag not in ("b", "i", "em", "strong", "a", "span", "u", "small", "code") else "")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif not self.hidden:
            self.out.append(" " if tag not in ("b", "i", "em", "strong", "a", "span", "u", "small", "code") else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_words_of_real_pages():
    pages = pq.read_table(f"{DIR}/pages.parquet").column("html").to_pylist()
    letters = lambda s: [c for c in s if c.isalnum()]
    for page in pages:
        sheet = Sheet()
        for part in page.split("<style>")[1:]:
            sheet.read(part.split("</style>")[0])
        words = Words({k[1:] for k, rules in sheet.by.items() if k[0] == "." and any(f.get("display", (0, ""))[1] == "none" for *_, f in rules)})
        words.feed(page)
        words.close()
        got, want = extract(page), "".join(words.out)
        numbers = sum(line.lstrip().split(". ")[0].isdigit() for line in got.split("\n"))
        if numbers:  # list numbers are added by the layout
            import re

            got = "\n".join(re.sub(r"^\s*\d+\. ", "", line) for line in got.split("\n"))
        assert letters(got) == letters(want), page[:500]
