"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words, in built-in expressions only.

A text is cut after every ``\n`` into paragraphs, and a paragraph into runs of some words: at each space between a
character of ``ENDS`` and one of ``BEGINS``, which is dropped, so runs joined by spaces are the paragraph. All cuts depend
on what stands about them alone, so an edit moves no other cut. A run's leaf is half of its SHA-256 digest. A paragraph's
node is the digest of its leaves in order, a section's that of its paragraphs, the root that of its sections, each level
with its own prefix. A section ends before a paragraph that follows a blank line, and after a paragraph whose node begins with one
of four of the sixteen digits, so texts without blank lines have sections too.

Equal roots mean equal texts. Otherwise the trees are descended together: sections that both begin or end with are
passed over by their nodes, then paragraphs inside the others, and only runs of paragraphs that the other side lacks are
looked at. ``edits`` names the paragraphs that went and those that came; a paragraph that only moved is neither.
Likeness is 1 for equal roots, and otherwise 1 - (runs that went + runs that came) / (runs of both), distinct ones each
and at least one of them: what an insertion costs is its own size.

A subtree is kept as one string, its node first and its children after it, so sets of subtrees are compared by hashing.

A null text is an empty text: its tree has no paragraph, its likeness to any other text is 0. A text without spaces is
one run per line. Rows may repeat; an empty table gives an empty result. ``fingerprinted`` replaces columns of the
names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import computed_once
from .common import text_of

_PARAGRAPH = r"(?<=\n)"
#: Ends and beginnings of words that a run is cut between.
ENDS = r"[a-hA-H0-4.,;:!?)à-ëα-θа-з]"
BEGINS = r"[i-zI-Z5-9(ì-ÿι-ωи-я]"
# Begins with the space itself, so that other characters are passed over quickly.
_RUN = rf"\x20(?={BEGINS})(?<={ENDS}\x20)"
#: A paragraph whose node begins with one of these digits ends its section.
LAST = "0123"
NODE, LEAF = 64, 32
#: Rows of one range of ids that are sorted together to find each document's successor: so many, or more where there
#: would be over ``RANGES`` ranges otherwise. The table of ranges has at most that many rows and 512 more, and 256 for each
#: id that holds a 256th of the rows: under 170,000 rows of some numbers and a digest.
ROWS_A_RANGE = 250
RANGES = 100_000
#: Id ranges of equal depth, measured first; inside each, ids are cut evenly.
COARSE = 256


# The expressions are SQL text: a tree takes some hundred nodes, each a call from Python to the JVM otherwise.


def _let(value: str, name: str, body: str) -> str:
    """The body over a value that is computed once, however often the body names it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _heads(subtrees: str) -> str:
    return f"array_join(transform({subtrees}, x -> substring(x, 1, {NODE})), '')"


def _paragraphs(sections: str) -> str:
    """The subtrees of all paragraphs of some sections."""
    return f"flatten(transform({sections}, s -> split(substring(s, {NODE + 2}), ';')))"


def _leaves(paragraphs: str) -> str:
    """The leaves of some paragraphs."""
    return f"flatten(transform({paragraphs}, s -> split(substring(s, {NODE + 2}), ',')))"


# Of a text's paragraphs ``ts`` the subtrees, ``node:leaf,leaf``.
_LEAVES_OF = f"transform(split(t, r'{_RUN}', -1), z -> substring(sha2(z, 256), 1, {LEAF}))"
_NODES = f"transform(ts, t -> {_let(f"array_join({_LEAVES_OF}, ',')", 'l', "concat(sha2(concat('P', l), 256), ':', l)")})"
# Of these, ``ns``, the numbers of those that end a section, from 1, and the sections' subtrees, ``node=paragraph;paragraph``.
_IS_LAST = f"i + 1 = size(ts) OR (ts[i + 1] <> '\n' AND (t = '\n' OR substring(ns[i], 1, 1) IN ({', '.join(map(repr, LAST))})))"
_CUTS = f"filter(transform(ts, (t, i) -> CASE WHEN {_IS_LAST} THEN i + 1 END), c -> c IS NOT NULL)"
_SLICE = "slice(ns, IF(k = 0, 1, cs[k - 1] + 1), c - IF(k = 0, 0, cs[k - 1]))"
_SECTIONS = f"transform(cs, (c, k) -> {_let(_SLICE, 'own', f"concat(sha2(concat('S', {_heads('own')}), 256), '=', array_join(own, ';'))")})"
_SECTIONS = f"CASE WHEN size(ts) > 0 THEN {_let(_CUTS, 'cs', _SECTIONS)} ELSE CAST(array() AS ARRAY<STRING>) END"
_TREE = f"named_struct('root', sha2(concat('R', {_heads('ss')}), 256), 'sections', ss, 'n', CAST(size(array_distinct({_leaves(_paragraphs('ss'))})) AS BIGINT))"


def tree(text: str) -> Column:
    """Of a text in SQL ``root``, ``sections`` (their subtrees in order) and ``n``, the number of distinct leaves."""
    texts = f"filter(split({text}, r'{_PARAGRAPH}', -1), t -> t <> '')"
    return F.expr(_let(_let(texts, "ts", _let(_NODES, "ns", _SECTIONS)), "ss", _TREE))


def _differing(a: str, b: str, body: str) -> str:
    """The body over what is left of two lists once their common beginning and then their common end are cut off, in
    ``m.a`` and ``m.b``, with the length of the beginning in ``head``."""
    common = "transform(array(array_position(zip_with(w.a, w.b, (p, q) -> p <=> q), false)), at -> CAST(IF(at > 0, at - 1, least(size(w.a), size(w.b))) AS INT))[0]"
    rest = "named_struct('a', slice(w.a, head + 1, size(w.a)), 'b', slice(w.b, head + 1, size(w.b)))"
    tail = _let("named_struct('a', reverse(r.a), 'b', reverse(r.b))", "w", common)
    middle = "named_struct('a', slice(r.a, 1, size(r.a) - tail), 'b', slice(r.b, 1, size(r.b) - tail))"
    inner = _let(rest, "r", _let(tail, "tail", _let(middle, "m", body)))
    return _let(f"named_struct('a', {a}, 'b', {b})", "w", _let(common, "head", inner))


def compared(a: str, b: str, located: bool = True) -> Column:
    """From two columns of trees ``n_removed`` and ``n_added`` (paragraphs that went and came), ``likeness`` and, unless
    not asked for, ``removed`` and ``added``: their places, from 0, in a and in b. Of paragraphs that repeat, so many are
    counted as there are more, and no place is named if the other side has their equal among those looked at."""
    nothing = "CAST(array() AS ARRAY<INT>)"

    def places(own: str, new: str) -> str:
        return f"filter(transform({own}, (x, i) -> CASE WHEN array_contains({new}, x) THEN before + head + i END), x -> x IS NOT NULL)" if located else nothing

    counts = f"""named_struct(
        'n_removed', CAST(greatest(size(d.g), size(m.a) - size(m.b)) AS BIGINT), 'n_added', CAST(greatest(size(d.c), size(m.b) - size(m.a)) AS BIGINT),
        'likeness', 1D - greatest(size(array_except(v.g, v.c)) + size(array_except(v.c, v.g)), 1) / ({a}.n + {b}.n),
        'removed', {places("m.a", "d.g")}, 'added', {places("m.b", "d.c")})"""
    runs = _let(f"named_struct('g', {_leaves('d.g')}, 'c', {_leaves('d.c')})", "v", counts)
    found = _let("named_struct('g', array_except(m.a, m.b), 'c', array_except(m.b, m.a))", "d", runs)
    # First sections, then the paragraphs of those that are left.
    inside = _let(f"size({_paragraphs(f'slice({a}.sections, 1, head)')})", "before", _differing(_paragraphs("m.a"), _paragraphs("m.b"), found))
    same = f"named_struct('n_removed', 0L, 'n_added', 0L, 'likeness', 1D, 'removed', {nothing}, 'added', {nothing})"
    return F.expr(f"CASE WHEN {a}.root = {b}.root THEN {same} ELSE {_differing(f'{a}.sections', f'{b}.sections', inside)} END")


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (the root, 64 hex digits) and ``tree``, which :func:`compared` takes."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("fingerprint", "tree")]
    return docs.select(*kept, tree(f"coalesce(CAST(`{text}` AS STRING), '')").alias("tree")).withColumn("fingerprint", F.col("tree.root"))


def _search(value: str, bounds: list[int], low: int = 0) -> str:
    """The number of bounds that are at most the value, as nested conditions of logarithmic depth."""
    if not bounds:
        return str(low)
    mid = len(bounds) // 2
    return f"IF({value} >= {bounds[mid]}, {_search(value, bounds[mid + 1 :], low + mid + 1)}, {_search(value, bounds[:mid], low)})"


_DIGEST = "md5(text)"


def _ranges(docs: DataFrame) -> tuple[Column, Column]:
    """The range of a row, and for rows of ids that many share a digest that tells them apart, empty for others.

    Ranges ascend with (id, digest), null ids last. They hold about as many rows as said above where ids are spread evenly
    within a 256th of them. Rows without an id, and those of an id that two of the 256 cuts fall on, are dealt over 256
    ranges by the first byte of their digest; only where there are such rows are texts read for it.
    """
    at = ", ".join(str(i / COARSE) for i in range(1, COARSE))
    some = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count("*"), F.expr(f"percentile_approx(doc_id, array({at}), 25600)"))
    lo, hi, n, every, cuts = some.first()
    byte = f"CAST(conv(substring({_DIGEST}, 1, 2), 16, 10) AS BIGINT)"
    if lo is None:
        return F.expr(byte), F.expr(_DIGEST)
    hot = {c for c in cuts if cuts.count(c) > 1}
    starts = sorted({lo, *cuts} | {c + 1 for c in hot if c < hi})
    fine = max(1, -(-n // (len(starts) * max(ROWS_A_RANGE, -(-n // RANGES)))))
    steps = [max(1, -(-(b - a) // fine)) for a, b in zip(starts, [*starts[1:], hi + 1], strict=True)]
    width = max(fine, 256)
    pick = lambda numbers: f"array({', '.join(f'CAST({x} AS BIGINT)' for x in numbers)})[c]"
    within = f"CAST(floor((doc_id - {pick(starts)}) / {pick(steps)}) AS BIGINT)"
    shared = "false"
    if hot:
        within = f"IF({pick([int(x in hot) for x in starts])} = 1, {byte}, {within})"
        shared = f"doc_id IN ({', '.join(map(str, sorted(hot)))})"
    place = _let(_search("doc_id", starts[1:]), "c", f"CAST(c AS BIGINT) * {width} + {within}")
    if every > n:
        place = f"IF(doc_id IS NULL, {len(starts) * width} + {byte}, {place})"
        shared = f"(doc_id IS NULL OR {shared})"
    return F.expr(place), F.expr("''" if shared == "false" else f"IF({shared}, {_DIGEST}, '')")


def with_next(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """Rows ``doc_id``, ``carry`` and, prefixed ``next_``, the carried columns of the next row by
    (doc_id, digest of the text, text), the last row's next being the first. Null ids come last.

    Ids alone say which row starts each range; that row is dealt to the range before as well, so the
    window over one range sees the successor of its last row. Texts are shuffled once.
    """
    place, tie = _ranges(docs)
    d = docs.select("doc_id", "text", place.alias("__range"), tie.alias("__tie"))
    firsts = d.select("doc_id", "__range", "__tie").groupBy("__range").agg(F.min(F.struct("doc_id", "__tie")).alias("__first"))
    chain, wrap = Window.orderBy("__range"), Window.partitionBy()
    firsts = firsts.select("__first", F.coalesce(F.lag("__range").over(chain), F.max("__range").over(wrap)).alias("__before"))
    first = F.broadcast(firsts)  # of bounded size, see RANGES
    d = d.join(first, d["doc_id"].eqNullSafe(first["__first.doc_id"]) & (d["__tie"] == first["__first.__tie"]), "left")
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__before").alias("r"), F.lit(True).alias("guest"))
    d = d.withColumn("__at", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    d = d.select("doc_id", "text", "__at.r", "__at.guest", F.expr(_DIGEST).alias("__digest")).repartition("r")
    d = d.select("*", *[c.alias(k) for k, c in carry.items()])
    w = Window.partitionBy("r").orderBy("guest", F.col("doc_id").asc_nulls_last(), "__digest", "text")
    following = [F.lead(k).over(w).alias(f"next_{k}") for k in carry]
    return d.select("doc_id", "guest", *carry, *following).where(~F.col("guest")).drop("guest")


def op1_fingerprint(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", text_of().alias("text"))
    # The ids order the texts, the tree is built after the shuffle and handed on to the row before.
    d = with_next(d, {"body": F.col("text"), "tree": tree("text")})
    d = d.withColumn("n_chars", F.length("body").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("body", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next_body", F.lit(1), cut))
    d = computed_once(d.select("doc_id", "n_chars", "tree", "next_tree", edited.alias("edited")))
    d = d.select("*", F.sha2("edited", 256).alias("edited_sha256"), tree("edited").alias("edited_tree"))
    d = computed_once(d.drop("edited"))
    to_edited, to_next = (compared("tree", x, located=False) for x in ("edited_tree", "next_tree"))
    d = computed_once(d.select("*", to_edited.alias("e"), to_next.getField("likeness").alias("near_next")))
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        F.col("e.likeness").alias("near_edited"),
        "near_next",
        F.size("tree.sections").cast("long").alias("n_sections"),
        F.expr(f"size({_paragraphs('tree.sections')})").cast("long").alias("n_paragraphs"),
        F.col("e.n_removed").alias("n_removed"),
        F.col("e.n_added").alias("n_added"),
    )


def _except_sql(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda z: NOT list_contains({b}, z))"


def _pair_sql(name: str, other: int) -> str:
    """Rows k, likeness and counts of tree 0 against another tree."""
    head = "coalesce(nullif(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), FALSE), 0) - 1, least(len(x), len(y)))"
    return f"""
{name}_0 AS (SELECT a.k, a.root = b.root AS same, a.n + b.n AS n, a.ss AS x, b.ss AS y FROM f a JOIN f b ON a.k = b.k AND a.v = 0 AND b.v = {other}),
{name}_1 AS (SELECT k, same, n, list_reverse(x[h + 1 :]) AS x, list_reverse(y[h + 1 :]) AS y FROM (SELECT *, {head} AS h FROM {name}_0)),
{name}_2 AS (SELECT k, same, n, flatten(list_reverse(x[h + 1 :])) AS x, flatten(list_reverse(y[h + 1 :])) AS y FROM (SELECT *, {head} AS h FROM {name}_1)),
{name}_3 AS (SELECT k, same, n, list_reverse(x[h + 1 :]) AS x, list_reverse(y[h + 1 :]) AS y FROM (SELECT *, {head} AS h FROM {name}_2)),
{name}_4 AS (SELECT k, same, n, x[h + 1 :] AS x, y[h + 1 :] AS y FROM (SELECT *, {head} AS h FROM {name}_3)),
{name}_5 AS (SELECT k, same, n, len(x) - len(y) AS more, {_except_sql("x", "y")} AS g, {_except_sql("y", "x")} AS c FROM {name}_4),
{name}_6 AS (SELECT *, flatten(g) AS gl, flatten(c) AS cl FROM {name}_5),
{name} AS (SELECT k, CASE WHEN same THEN 1.0 ELSE 1.0 - greatest(len({_except_sql("gl", "cl")}) + len({_except_sql("cl", "gl")}), 1)::DOUBLE / n END::DOUBLE AS likeness,
  CASE WHEN same THEN 0 ELSE greatest(len(g), more) END::BIGINT AS removed, CASE WHEN same THEN 0 ELSE greatest(len(c), -more) END::BIGINT AS added FROM {name}_6)"""


_CUT_SQL = "p"
for _ in range(2):  # the second time for words of one letter between two cuts
    _CUT_SQL = f"regexp_replace({_CUT_SQL}, '({ENDS}) ({BEGINS})', '\\1' || chr(1) || '\\2', 'g')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, '')), coalesce(text, '')) AS k, doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY k), first(t) OVER (ORDER BY k)) AS nt, length(t)::BIGINT AS n_chars FROM d),
e AS (SELECT *, substr(t, 1, n_chars - n_chars // 4) || substr(nt, 1, n_chars // 4) AS et FROM o),
x AS (SELECT k, 0 AS v, t AS s FROM e UNION ALL SELECT k, 1, et FROM e UNION ALL SELECT k, 2, nt FROM e),
l AS (SELECT k, v, unnest(string_split(s, chr(10))) AS p, generate_subscripts(string_split(s, chr(10)), 1) AS i, len(string_split(s, chr(10))) AS m FROM x),
p AS (SELECT k, v, i, CASE WHEN i < m THEN p || chr(10) ELSE p END AS p FROM l WHERE i < m OR p <> ''),
u AS (SELECT k, v, i, p, list_transform(string_split({_CUT_SQL}, chr(1)), lambda z: substr(sha256(z), 1, {LEAF})) AS ls FROM p),
h AS (SELECT *, sha256('P' || array_to_string(ls, ',')) AS ph FROM u),
b AS (SELECT *, lag(p) OVER w AS before, lag(ph) OVER w AS ph_before FROM h WINDOW w AS (PARTITION BY k, v ORDER BY i)),
g AS (SELECT *, sum((before IS NOT NULL AND p <> chr(10) AND (before = chr(10) OR contains('{LAST}', substr(ph_before, 1, 1))))::INT) OVER (PARTITION BY k, v ORDER BY i) AS section FROM b),
s AS (SELECT k, v, section, list(ls ORDER BY i) AS ps, sha256('S' || string_agg(ph, '' ORDER BY i)) AS sh FROM g GROUP BY k, v, section),
r AS (SELECT k, v, sha256('R' || string_agg(sh, '' ORDER BY section)) AS root, list(ps ORDER BY section) AS ss FROM s GROUP BY k, v),
f AS (SELECT x.k, x.v, coalesce(r.root, sha256('R')) AS root, coalesce(ss, []) AS ss, coalesce(len(list_distinct(flatten(flatten(ss)))), 0) AS n FROM x LEFT JOIN r ON r.k = x.k AND r.v = x.v),
{_pair_sql("ed", 1)},
{_pair_sql("nx", 2)}
SELECT e.doc_id, e.n_chars, sha256(e.et) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint, ed.likeness AS near_edited, nx.likeness AS near_next,
  len(a.ss)::BIGINT AS n_sections, len(flatten(a.ss))::BIGINT AS n_paragraphs, ed.removed AS n_removed, ed.added AS n_added
FROM e JOIN f a ON a.k = e.k AND a.v = 0 JOIN f b ON b.k = e.k AND b.v = 1 JOIN ed ON ed.k = e.k JOIN nx ON nx.k = e.k
"""
