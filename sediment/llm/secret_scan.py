"""Secret scan with multipart credential linking, in built-in expressions only.

Strong kinds stand on their own: ``assign`` (a keyword, ``:`` or ``=``, a value of 8 or more
characters), ``access`` (``AKIA`` and capitals or digits, 16 or more characters), ``hex`` (32 or
more lowercase hex digits). Weak kinds are ``client`` (an account or client identifier that is
assigned), ``endpoint`` (a URL) and ``opaque`` (a run of 20 or more key characters with capitals,
small letters and digits, outside the spans of the strong kinds and of clients: an identifier's own value is no
secret). A weak candidate is reported only if its complement lies in its scope, the ``SCOPE`` code points before and
after it, and shares no character with it:

    client     a secret (assign, hex, opaque)
    opaque     an identifier (client, access)
    endpoint   an identifier and a secret

Candidates are exploded to rows, and the interval join is a sweep over their starts and ends: at a candidate's start the
furthest end of each part so far, at its end the first start of each part from there on say whether one lies in scope.
Parts that overlap the candidate have not ended by its start and do not start after its end, so they never count. A text
with k candidates costs O(k log k); pairs are never made. Only candidates are shuffled, never texts.

Positions are code points, ends exclusive. A null or empty text has no spans, repeated rows are separate rows, a null id
stays null, an empty table gives an empty result. A text may be of any length. Other columns are carried as they are,
whatever their names; those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

SCOPE = 400
LEAST_VALUE = 8

# The base patterns of the contract (a run that is long enough is the whole run).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

CLIENT = r"""(?i:client_?id|account_?id|user_?name|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"""
_LONG = "[A-Za-z0-9+/_-]{20,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])" + _LONG

#: In the order that breaks ties between spans with one start.
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("client", CLIENT), ("endpoint", ENDPOINT), ("opaque", OPAQUE))
STRONG = ("assign", "access", "hex")
IDENTIFIERS = ("access", "client")
SECRETS = ("assign", "hex", "opaque")


def _passes(kind: str, found: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(found, ASSIGN, 2)) >= LEAST_VALUE
    if kind == "opaque":
        return found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")
    return F.lit(True)


def _rows_of(order: int, kind: str) -> Column:
    # Zipped outside the lambda: inside it, the split that the gaps come from would be made again for each match.
    m = F.col(f"__m_{kind}")
    zipped = F.arrays_zip(m.alias("m"), F.slice(F.col(f"__p_{kind}"), F.lit(1), F.size(m)).alias("gap"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(order).alias("order"), F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["m"].alias("found")
        ),
    )
    return F.when(F.size(m) > 0, rows).otherwise(F.array().cast("array<struct<order:int,kind:string,i:int,gap:int,found:string>>"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate, ``order, kind, i, gap, found``, and one with null ``kind`` per text without any.

    ``__row`` numbers the input rows, ``__doc`` holds their other columns. Spark gives matches but not their places, so a
    place is the running sum of the lengths of the pieces that the same pattern splits the text into.
    """
    d = docs.select(_carried(docs, text).alias("__doc"), text_of(f"`{text}`").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    d = d.select("*", *[F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"__m_{k}") for k, p in KINDS])
    for kind, pattern in KINDS:
        d = d.withColumn(f"__p_{kind}", F.when(F.size(f"__m_{kind}") > 0, F.transform(F.split("__text", pattern, -1), F.length)))
    every = F.concat(*[_rows_of(order, kind) for order, (kind, _) in enumerate(KINDS)])
    return d.select("__doc", "__row", F.explode_outer(every).alias("c")).select("__doc", "__row", "c.*")


def _carried(docs: DataFrame, text: str) -> Column:
    """The columns but the text as one struct, under names of their places."""
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    return F.struct(*kept) if kept else F.struct(F.lit(None).alias("c"))


def _swept(docs: DataFrame, text: str) -> DataFrame:
    """Rows of :func:`candidates` that are reported, with ``start`` and ``end``; texts without any keep rows whose kind
    is null."""
    d = candidates(docs, text)
    run = Window.partitionBy("__row", "order").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("found")
    d = d.withColumn("end", F.sum(F.col("gap") + size).over(run)).withColumn("start", F.col("end") - size)
    passes = F.lit(True)
    for kind, _ in KINDS:
        if kind in ("assign", "opaque"):
            passes = passes & ((F.col("kind") != kind) | _passes(kind, F.col("found")))
    d = d.withColumn("kind", F.when(passes, F.col("kind")))
    # A candidate that fails is a row of nulls too: its text keeps a row.
    before = Window.partitionBy("__row").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__row").orderBy(F.col("start").desc(), F.col("order").desc()).rowsBetween(Window.unboundedPreceding, -1)
    covers = F.col("kind").isin(*STRONG, "client")
    covered = F.coalesce(F.max(F.when(covers, F.col("end"))).over(before) > F.col("start"), F.lit(False))
    covered = covered | F.coalesce(F.min(F.when(covers, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    d = d.withColumn("__covered", covered).withColumn("kind", F.when((F.col("kind") != "opaque") | ~F.col("__covered"), F.col("kind")))
    # The sweep. At one place ends come before starts: neighbours that touch share no character.
    events = F.array(F.struct(F.lit(0).alias("side"), F.col("end").alias("at")), F.struct(F.lit(1).alias("side"), F.col("start").alias("at")))
    d = d.select("__row", "__doc", "order", "i", "kind", "found", "start", "end", F.explode(events).alias("e"))
    so_far = Window.partitionBy("__row").orderBy("e.at", "e.side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.partitionBy("__row").orderBy(F.col("e.at").desc(), F.col("e.side").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for name, kinds in (("identifier", IDENTIFIERS), ("secret", SECRETS)):
        part = F.col("kind").isin(*kinds)
        behind = F.col("start") - F.max(F.when(part & (F.col("e.side") == 0), F.col("end"))).over(so_far) <= SCOPE
        ahead = F.min(F.when(part & (F.col("e.side") == 1), F.col("start"))).over(from_here) - F.col("end") <= SCOPE
        d = d.withColumn(f"__{name}", F.when(F.col("e.side") == 1, behind).otherwise(ahead))
    both = Window.partitionBy("__row", "start", "order", "i")
    near = lambda name: F.coalesce(F.max(f"__{name}").over(both), F.lit(False))
    d = d.withColumn("__near", F.struct(near("identifier").alias("identifier"), near("secret").alias("secret"))).where("e.side = 1")
    linked = (
        F.when(F.col("kind").isin(*STRONG), F.lit(True))
        .when(F.col("kind") == "client", F.col("__near.secret"))
        .when(F.col("kind") == "opaque", F.col("__near.identifier"))
        .when(F.col("kind") == "endpoint", F.col("__near.identifier") & F.col("__near.secret"))
    )
    return d.select("__row", "__doc", F.when(linked, F.col("kind")).alias("kind"), "start", "order", "end", "found")


def _uncarried(docs: DataFrame, text: str, *outputs: str) -> list[Column]:
    return [F.col(f"__doc.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != text and c not in outputs]


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row ``kind, start, end, found`` per span beside the other columns of ``docs``; texts without any have no row."""
    d = _swept(docs, text).where("kind IS NOT NULL")
    names = ("kind", "start", "end", "found")
    return d.select(*_uncarried(docs, text, *names), *names)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``spans``: an array of ``(start, order, end, kind, found)`` by start."""
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "order", "end", "kind", "found"))
    rows = _swept(docs, text).groupBy("__row").agg(F.first("__doc").alias("__doc"), F.sort_array(F.collect_list(one)).alias("__spans"))
    return rows.select(*_uncarried(docs, text, "spans"), F.col("__spans").alias("spans"))


def _said(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op5_secret_scan(docs: DataFrame) -> DataFrame:
    d = found(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return d.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(_said(base), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
    )


def _sql(pattern: str) -> str:
    """The pattern for an engine without look-behind, which only saves time here, as an SQL string."""
    return "'" + pattern.replace(OPAQUE, _LONG).replace("'", "''") + "'"


_FOUND_SQL = " UNION ALL ".join(
    f"SELECT r, {i} AS o, '{kind}' AS kind, regexp_extract_all(t, {_sql(p)}) AS f, string_split_regex(t, {_sql(p)}) AS g FROM d" for i, (kind, p) in enumerate(KINDS)
)
_IS = {name: "kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")" for name, kinds in (("base", STRONG), ("covers", (*STRONG, "client")), ("identifier", IDENTIFIERS), ("secret", SECRETS))}


def _near_sql(name: str) -> str:
    """Whether a part that shares no character with the candidate ``x`` lies in its scope."""
    return f"EXISTS (SELECT 1 FROM c y WHERE y.r = x.r AND y.{_IS[name]} AND (y.e <= x.s AND x.s - y.e <= {SCOPE} OR y.s >= x.e AND y.s - x.e <= {SCOPE}))"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_FOUND_SQL}),
u AS (SELECT r, o, kind, unnest(f) AS x, generate_subscripts(f, 1) AS i, g FROM m WHERE len(f) > 0),
p AS (SELECT r, o, kind, x, (sum(length(g[i]) + length(x)) OVER (PARTITION BY r, o ORDER BY i))::BIGINT AS e FROM u),
q AS (SELECT r, o, kind, e - length(x) AS s, e FROM p WHERE (kind <> 'assign' OR length(regexp_extract(x, {_sql(ASSIGN)}, 2)) >= {LEAST_VALUE})
  AND (kind <> 'opaque' OR regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))),
c AS (SELECT * FROM q x WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM q y WHERE y.r = x.r AND y.{_IS["covers"]} AND y.s < x.e AND y.e > x.s)),
k AS (SELECT r, o, kind, s, e FROM c x WHERE {_IS["base"]} OR kind = 'client' AND {_near_sql("secret")}
  OR kind = 'endpoint' AND {_near_sql("identifier")} AND {_near_sql("secret")} OR kind = 'opaque' AND {_near_sql("identifier")}),
j AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER ({_IS["base"]}), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM k GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""
