"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

*Base spans* (``email, ip, card, phone``) are fixed patterns with their checks; they always stand.

*Added spans.* Generators of high recall propose overlapping candidates of six further kinds: national phone
numbers, spelled-out e-mail addresses, card-like numbers of other lengths or separators, IBANs, social-security
numbers and IPv6 addresses, shortened ones too. Boosted trees score each from its format (lengths, groups, separators,
check digits, whether it is a date) and its context (how far telling words are before and after it, prices, units,
neighbours that are digits). The scores are calibrated on rows that the trees have not seen, and each kind has the lowest
threshold that kept ``PRECISION`` on rows that neither has seen. Of overlapping candidates the likeliest stays, and none
that touches a base span is added.

The trees are fitted on ``TRAINING_ROWS`` candidates that a seeded grammar writes, a third of them for each of these three
steps; no corpus is read for it. A candidate is right only if it is the whole of an item of its own kind.

Positions are code points, ends exclusive. A null or empty text has no spans, repeated rows and null ids are
carried, an empty table gives an empty result. Every pattern is linear in the text, of whatever length. Other columns
are carried whatever their names; those named like an output are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import carried, through_python

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "email_spelled", "card_other", "iban", "ssn", "ipv6")
KINDS = BASE + ADDED
TRAINING_ROWS = 12_000
PRECISION = 0.99
REACH = 40
#: Texts that are held as Python strings at once.
TEXTS = 64

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Digits can only be matched from the start of their run, so these are the base patterns without retries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]")

GENERATORS = {
    "phone_local": re.compile(
        r"(?<![0-9A-Za-z+.])(?:\(?[0-9]{2,5}(?:\)[ ./-]{0,2}|[ ./-]{1,2})[0-9]{2,8}(?:[ ./-]{1,2}[0-9]{2,8}){0,3}|[0-9]{9,11})(?![0-9A-Za-z])"
    ),
    "email_spelled": re.compile(
        r"\b[A-Za-z0-9_-]{1,32}(?:\.[A-Za-z0-9_-]{1,32}){0,3}\s?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{2,40}(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\}| dot )\s?|\.)[A-Za-z]{2,12}){1,3}\b"
    ),
    "card_other": re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])"),
    # Four to eight groups, or any number of them about a ``::``; a single colon may follow.
    "ipv6": re.compile(
        r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}(?:[0-9A-Fa-f]{1,4}|:)"
        r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"
        r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z]|:[0-9A-Za-z:])"
    ),
}
_CUES = (
    re.compile(r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|telefon|telefax|handy|mobil|téléphone|portable|teléfono|móvil|whatsapp|sms|dial|ring|reach|erreichen|rufen|appelez|llame|hotline|number is)\b"),
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|schreib|schreiben|correo|courriel|address)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|payment|paid|charge)\b"),
    re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank|transfer|überweisung|virement)\b"),
    re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
    re.compile(r"(?i)\b(?:ip|ipv6|address|host|server|ping|dns|gateway|router|connect|listens?)\b"),
    re.compile(r"(?i)\b(?:date|dated|year|since|until|version|page|pages|chapter|isbn|order|invoice|nr|ref|id|model|part|section|on|from|between|total|volume|serial|item|code|time|class|namespace|bill|key)\b"),
)
_PRICE = re.compile(r"[$€£%]|\b(?:USD|EUR|kg|km|cm|mm)\b")
_DATE = re.compile(r"(?:(?:1[89]|20)[0-9]{2}[ ./-]{1,2}(?:0?[1-9]|1[0-2])[ ./-]{1,2}(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[ ./-]{1,2}(?:0?[1-9]|[12][0-9]|3[01])[ ./-]{1,2}(?:1[89]|20)[0-9]{2})")
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        # What may stand before the @ back to the last match; the run is followed back piece by piece.
        start, step = at, 128
        while start > done:
            piece = text[max(done, start - step) : start]
            own = len(piece) - len(piece.rstrip(_LOCAL))
            start -= own
            if own < len(piece):
                break
            step *= 2
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the added kinds."""
    out = []
    digits = _ANY.search(text) is not None
    for kind, p in GENERATORS.items():
        if kind == "email_spelled":
            if not ("at)" in text or "at]" in text or "at}" in text or " at " in text):
                continue
        elif not digits and not (kind == "ipv6" and "::" in text):
            continue
        out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s, before, after = text[a:b], text[max(0, a - REACH) : a], text[b : b + REACH]
    d = _NOT_DIGIT.sub("", s)
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    first = [*map(len, groups[:4]), 0, 0, 0, 0][:4]
    seps = re.sub(r"[0-9A-Za-z]", "", s)
    near = before[-12:] + after[:12]
    return [
        float(KINDS.index(kind)),
        len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), *first,
        len(set(seps)), seps.count("-"), seps.count("."), seps.count("/"), seps.count(" "), float("(" in seps), seps.count(":"), float("::" in s),
        float(len(d) >= 12 and luhn(d)),
        float(kind == "iban" and _iban_ok(s)),
        float(_DATE.fullmatch(s) is not None),
        float(d[:1] == "0"), float(d[:2] in ("19", "20")), float(len(set(d)) <= 2),
        float("at)" in s or "at]" in s or "at}" in s), float("dot" in s),
        float(len(s.split(".")[-1]) in (2, 3)),
        *[min((len(before) - m.end() for m in c.finditer(before)), default=REACH + 1) for c in _CUES],
        *[min((m.start() for m in c.finditer(after)), default=REACH + 1) for c in _CUES],
        float(bool(_PRICE.search(near))),
        float(sum(c.isdigit() for c in before[-6:]) > 0), float(sum(c.isdigit() for c in after[:6]) > 0),
    ]


class _Grammar:
    """Writes texts with one item each, personal or not."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def n(self, *sizes: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(self.rng.choice(sizes)))

    def word(self) -> str:
        return "".join(self.rng.choice("etaoinshrdlu") for _ in range(self.rng.randint(2, 8)))

    def lead(self, *cues: str) -> str:
        join = self.rng.choice(["", "", " number", " no.", ".", f" {self.word()}", f" {self.word()} {self.word()}"])
        join += self.rng.choice([" ", " ", ": ", " is ", " at ", " on ", " under ", " = ", " is now ", ":\n"])
        return self.rng.choice(cues) + join

    def year(self) -> str:
        return self.rng.choice(["19", "20"]) + self.n(2)

    def date(self) -> str:
        sep, day, month = self.rng.choice("-/. "), f"{self.rng.randint(1, 28):02d}", f"{self.rng.randint(1, 12):02d}"
        return sep.join(self.rng.choice([(self.year(), month, day), (day, month, self.year()), (month, day, self.year())]))

    def phone_local(self, yes: bool) -> tuple[str, str]:
        n = self.n
        cue = lambda: self.lead("tel", "phone", "call", "mobile", "Telefon", "téléphone", "fax", "cell", "my number is", "dial", "Handy", "whatsapp", "reach me")
        if yes:
            forms = [f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)} {n(3)} {n(4)}", f"0{n(3)} {n(5, 6, 7, 8)}", f"0{n(2)} {n(3)} {n(2)} {n(2)}", f"{n(3)}.{n(3)}.{n(4)}", n(10), f"0{n(8, 9, 10)}", f"0{n(2)} {n(6, 7, 8)}", f"0{n(2, 3, 4)}/{n(5, 6, 7, 8)}", f"({n(3)}){n(3)}-{n(4)}", f"({n(3)}) {n(7)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(2, 3)}-{n(6, 7)}"]
            return cue(), self.rng.choice(forms)
        odd = ["", "on ", "page ", "version ", "order ", "pages ", "$", "invoice no ", "ISBN ", "id ", "ref ", "at ", "total ", "serial ", "item code "]
        forms = [f"{self.year()}-{self.year()}", f"{n(3)}.{n(3)}", f"{n(2)} {n(3)}", f"{n(4)}-{n(4)}", f"{n(2)}-{n(2)}", f"{n(3)} {n(3)} {n(3)}", n(9, 10, 11), f"1{n(9)}", f"{self.year()} {n(6)}", f"{n(4)} {n(7)}", f"{n(3)}-{n(8)}", f"({self.year()}){n(3)}-{n(3)}", f"({n(2)}) {n(6)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)} {n(3)} {n(4)}"]
        if self.rng.random() < 0.4:  # dates and small numbers, even after such a word
            return self.rng.choice([cue(), cue(), "on ", "since ", "dated ", ""]), self.rng.choice([self.date(), self.date(), f"{n(2)} {n(2)}", f"{self.year()}-{self.year()}"])
        return self.rng.choice(odd), self.rng.choice(forms)

    def email_spelled(self, yes: bool) -> tuple[str, str]:
        word, pick = self.word, self.rng.choice
        if yes:
            item = f"{pick([word(), word()[:1]])}{pick(['', '.' + word(), '_' + word(), '-' + word(), self.n(2)])}{pick([' (at) ', ' [at] ', '(at)', ' at ', '[at]', ' {at} '])}{word()}{pick(['', '-' + word()])}{pick([' dot ', ' (dot) ', ' [dot] ', '.', '(dot)'])}{pick(['com', 'org', 'net', 'de', 'fr', 'es'])}"
            return (self.lead("email", "mail", "contact", "write", "reach me") if " at " in item or self.rng.random() < 0.7 else ""), item
        return pick(["", "on ", "look ", "we met ", "since "]), f"{word()} at {word()}{pick(['. ', ' .', '.'])}{word()}"

    def card_other(self, yes: bool) -> tuple[str, str]:
        sep, size = self.rng.choice(["", " ", "-", "."]), self.rng.choice([13, 14, 15, 16, 19])
        body = self.n(size - 1)
        digits = next(body + c for c in "0123456789" if luhn(body + c) == (yes or self.rng.random() < 0.1))
        cue = self.lead("card", "visa", "credit card", "payment by", "mastercard", "Karte", "tarjeta")
        return cue if yes else self.rng.choice(["", "order ", "id ", "ref ", "part no ", "serial ", cue]), sep.join(digits[i : i + 4] for i in range(0, size, 4))

    def iban(self, yes: bool) -> tuple[str, str]:
        country, body = self.rng.choice(["DE", "FR", "ES", "GB", "NL", "IT", "AT"]), self.n(14, 16, 18, 20)
        code = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        item = country + f"{code if yes else (code + self.rng.randint(1, 90)) % 97:02d}" + body
        cue = self.lead("IBAN", "account", "Konto", "transfer to", "compte") if self.rng.random() < 0.8 else ""
        return cue if yes else self.rng.choice(["", "id ", "model ", cue]), self.rng.choice([item, " ".join(item[i : i + 4] for i in range(0, len(item), 4))])

    def ssn(self, yes: bool) -> tuple[str, str]:
        return self.lead("SSN", "social security", "ssn", "Social Security", "taxpayer") if yes else self.rng.choice(["", "part ", "order no ", "model ", "phone ", "tel: ", "call ", "ref ", "page "]), self.rng.choice(["-", "-", " "]).join((self.n(3), self.n(2), self.n(4)))

    def ipv6(self, yes: bool) -> tuple[str, str]:
        pick, n = self.rng.choice, self.n
        if yes:
            group = lambda: f"{self.rng.randrange(1 << pick([4, 8, 16, 16])):x}"
            groups = lambda least, most: ":".join(group() for _ in range(self.rng.randint(least, most)))
            net = lambda: pick([f"20{n(2)}", "fe80", "fd" + n(2), f"2a0{n(1)}"])
            item = pick([":".join(f"{self.rng.randrange(1 << 16):x}" for _ in range(8)), f"{net()}::{groups(1, 4)}", f"{net()}:{groups(1, 3)}::{groups(1, 3)}", f"{net()}:{groups(1, 3)}::", "::1", f"::{groups(2, 3)}"])
            return (self.lead("host", "ip", "address", "server", "ping", "gateway", "connect to") if self.rng.random() < 0.8 else ""), pick([item, item.upper()])
        name = lambda: "".join(pick("abcdef") for _ in range(self.rng.randint(1, 4)))
        item = pick([":".join(n(2) for _ in range(4)), f"{name()}::{name()}", f"{name().title()}::{name().title()}", f"::{name()}", f"{n(1)}::{n(2)}", f"{n(2)}::{n(2)}", f"{name()}::"])
        return pick(["", "at ", "on ", "use ", "class ", "time ", "namespace "]), item

    def text(self) -> tuple[str, str, str, str, bool]:
        """(before, item, after, kind, personal)."""
        kind, yes = self.rng.choice(ADDED), self.rng.random() < 0.5
        lead, item = getattr(self, kind)(yes)
        words = lambda: " ".join(self.word() for _ in range(self.rng.randint(1, 8)))
        tail = self.rng.choice([" ", ". ", ", ", "; ", ") "]) if yes or self.rng.random() < 0.8 else self.rng.choice([" EUR ", "% ", " kg ", " pages "])
        head = words() + " " if self.rng.random() < 0.85 else ""
        return head + lead, item, tail + words(), kind, yes


def training_rows(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Candidates of the generators in texts of the grammar; a candidate is right if it is the whole of a personal item
    of its kind."""
    grammar = _Grammar(seed)
    x, y, kinds = [], [], []
    while len(x) < count:
        head, item, tail, own, yes = grammar.text()
        a, b = len(head), len(head) + len(item)
        for kind, i, j in candidates(head + item + tail):
            x.append(features(head + item + tail, kind, i, j))
            y.append(float(yes and kind == own and i == a and j == b))
            kinds.append(kind)
    return np.array(x[:count]), np.array(y[:count]), kinds[:count]


@lru_cache(maxsize=1)
def model(rows: int = TRAINING_ROWS, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The fitted trees and a threshold for each added kind; 2 if no score is precise enough."""
    x, y, kinds = training_rows(rows)
    part = np.arange(rows) % 3
    trees = Boosted().fit(x[part == 0], y[part == 0], x[part == 1], y[part == 1])
    last = part == 2
    p, names, truth = trees(x[last]), np.array(kinds)[last], y[last]
    limits = {}
    for kind in ADDED:
        own = names == kind
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(good >= precision)
        limits[kind] = max(0.5, float(p[own][order][ok[-1]])) if len(ok) else 2.0
    return trees, limits


def find_spans(texts: list[str], trees: Boosted, limits: dict[str, float]) -> list[list[tuple[str, int, int, float]]]:
    """Per text its spans by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    added: list[list] = [[] for _ in texts]
    if proposed:
        p = trees(np.array([features(texts[i], k, a, b) for i, k, a, b in proposed]))
        order = sorted(range(len(proposed)), key=lambda r: (proposed[r][0], -p[r], proposed[r][2], proposed[r][3]))
        taken: dict[int, list] = {}
        for r in order:
            i, kind, a, b = proposed[r]
            if p[r] < limits[kind]:
                continue
            if i not in taken:
                taken[i] = _Disjoint((s, e) for _, s, e in base[i])
            if taken[i].add(a, b):
                added[i].append((kind, a, b, float(p[r])))
    rank = {k: n for n, k in enumerate(KINDS)}
    return [sorted([(*s, 1.0) for s in b] + extra, key=lambda s: (rank[s[0]], s[1], s[2])) for b, extra in zip(base, added)]


class _Disjoint:
    """Intervals that later ones must not touch."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in merged(spans):
            self.starts.append(a), self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        import bisect

        k = bisect.bisect_right(self.starts, a)
        if k and self.ends[k - 1] > a or k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a), self.ends.insert(k, b)
        return True


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or group of overlapping ones, replaced by the kind of its first."""
    if not spans:
        return text
    first = {}
    for kind, a, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        first.setdefault(a, kind)
    out, at = [], 0
    for a, b in merged((a, b) for _, a, b, _ in spans):
        out += [text[at:a], f"<{first[a].split('_')[0].upper()}>"]
        at = b
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch], trees: Boosted, limits: dict[str, float], redacting: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, out = batch.column(0), []
        for at in range(0, len(column), TEXTS):
            given = column.slice(at, TEXTS).to_pylist()
            texts = [t or "" for t in given]
            for old, t, spans in zip(given, texts, find_spans(texts, trees, limits)):
                if redacting:  # a text without spans stays as it was, null included
                    out.append(redact(t, spans) if spans else old)
                else:
                    out.append([{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in spans])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string() if redacting else _SPANS), *batch.columns[1:]], names=batch.schema.names)


def _run(docs: DataFrame, text: str, redacting: bool) -> tuple[DataFrame, list[str]]:
    trees, limits = model()
    scan = partial(_scan, trees=trees, limits=limits, redacting=redacting)
    return through_python(docs, text, "string", lambda b: scan(b), "string" if redacting else SPANS)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``spans``: kind, start, end, score (1 for base spans)."""
    out, others = _run(docs, text, False)
    return out.select(*carried(others, "spans"), F.col("value").alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind, and ``n_chars``, if there is one, counted anew."""
    out, others = _run(docs, text, True)
    new = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text: F.col("value")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("value").isNull(), new["n_chars"]).otherwise(F.length("value")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) for c in docs.columns])


def _said(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii(docs: DataFrame) -> DataFrame:
    d = found(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return d.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
