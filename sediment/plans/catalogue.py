"""The engine's queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, cms, hll, serial, simhash
from ..functions.hashing import seed_hex
from ..functions.plan import spread
from ..functions.shared import folder, written
from ..operators import cache, compact, integrity, limiter, runs, view
from ..schema import KVConfig
from ..sources import mutations as M
from ..sources import wal
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = KVConfig()
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The logs of the sources module, in SQL.
_BY_TYPE = "l AS (SELECT event_type || ':' || lpad(user_id::VARCHAR, 6, '0') AS k, event_id::VARCHAR AS v, epoch_us(ts) AS seq, 'PUT' AS op, user_id::VARCHAR AS u FROM events)"
_BY_USER = "l AS (SELECT 'user:' || lpad(user_id::VARCHAR, 6, '0') AS k, CASE WHEN event_type = 'error' THEN '' ELSE event_id::VARCHAR END AS v, epoch_us(ts) AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, user_id::VARCHAR AS u, epoch_us(ts) // 1000000 AS secs FROM events)"
_RUNS = "l AS (SELECT event_type || ':' || lpad(user_id::VARCHAR, 6, '0') AS k, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_id::VARCHAR END AS v, epoch_us(ts) AS seq, CASE WHEN event_id % 5 = 0 THEN 'DELETE' ELSE 'PUT' END AS op, (event_id % 8)::INT AS run_id, (event_id % 8 // 4)::INT AS level FROM events)"
_LATEST = "n AS (SELECT k, arg_max({'op': op, 'v': v, 'seq': seq}, seq) AS x FROM l GROUP BY k), m AS (SELECT k AS key, x.op AS op, x.v AS value, x.seq AS seq FROM n)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Views and reads.


@query(f"WITH {_BY_TYPE}, {_LATEST} SELECT key, value FROM m")
def kv_latest(spark, sf_dir):
    return view.view(M.events_by_type(spark, sf_dir))


@query(f"WITH {_BY_USER}, {_LATEST} SELECT key, value FROM m WHERE op <> 'DELETE'")
def kv_latest_masked(spark, sf_dir):
    return view.view(M.events_by_user(spark, sf_dir))


@query(f"WITH {_BY_USER}, {_LATEST} SELECT key, op, value FROM m")
def kv_include_tombstones(spark, sf_dir):
    return view.view(M.events_by_user(spark, sf_dir), include_tombstones=True)


@query(f"WITH {_BY_USER}, {_LATEST} SELECT key, value FROM m WHERE op <> 'DELETE' ORDER BY key")
def kv_sorted(spark, sf_dir):
    """The sorted view without deletions, as an ordered in-memory table gives it."""
    return view.view(M.events_by_user(spark, sf_dir)).orderBy("key")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042'")
def kv_point_get(spark, sf_dir):
    return view.get(M.customers(spark, sf_dir), "Customer#000000042")


@query(f"WITH {_BY_TYPE}, {_LATEST} SELECT key, value FROM m WHERE key IN (SELECT 'click:' || lpad(c_custkey::VARCHAR, 6, '0') FROM customer)")
def kv_multi_get(spark, sf_dir):
    keys = M.read(spark, sf_dir, "customer").select(F.concat(F.lit("click:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return view.multi_get(M.events_by_type(spark, sf_dir), keys)


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = 'nobody'")
def kv_get_miss(spark, sf_dir):
    return view.get(M.customers(spark, sf_dir), "nobody")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def kv_prefix_scan(spark, sf_dir):
    return view.prefix(M.customers(spark, sf_dir), "Customer#00000001")


@query("SELECT p_name AS key, arg_max(p_brand, p_partkey) AS value FROM part WHERE starts_with(p_name, 'red') GROUP BY p_name ORDER BY key LIMIT 3 OFFSET 3")
def kv_prefix_page(spark, sf_dir):
    return view.page(view.prefix(M.parts(spark, sf_dir), "red"), 2, 3)


@query("SELECT p_name AS key, arg_max(p_brand, p_partkey) AS value FROM part GROUP BY p_name")
def kv_prefix_empty(spark, sf_dir):
    return view.prefix(M.parts(spark, sf_dir), "")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000099'")
def kv_range_scan(spark, sf_dir):
    return view.key_range(M.customers(spark, sf_dir), "Customer#000000010", "Customer#000000099")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000099' ORDER BY key LIMIT 20 OFFSET 40")
def kv_range_page(spark, sf_dir):
    return view.page(view.key_range(M.customers(spark, sf_dir), "Customer#000000010", "Customer#000000099"), 3, 20)


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name BETWEEN 'b' AND 'a'")
def kv_range_inverted(spark, sf_dir):
    return view.key_range(M.customers(spark, sf_dir), "b", "a")


@query("SELECT c_name AS key, c_mktsegment AS value, lead(c_name) OVER (ORDER BY c_name) IS NOT NULL AS has_next FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def kv_iterate_prefix(spark, sf_dir):
    return view.steps(view.prefix(M.customers(spark, sf_dir), "Customer#0000000"))


@query("SELECT c_name AS key, c_mktsegment AS value, lead(c_name) OVER (ORDER BY c_name) IS NOT NULL AS has_next FROM customer WHERE c_name BETWEEN 'Customer#000000005' AND 'Customer#000000050'")
def kv_iterate_range(spark, sf_dir):
    return view.steps(view.key_range(M.customers(spark, sf_dir), "Customer#000000005", "Customer#000000050"))


@query(
    f"""WITH {_RUNS}, a AS (SELECT k, arg_max({{'op': op, 'v': v}}, seq) AS x FROM l WHERE level = 0 GROUP BY k),
    b AS (SELECT k, arg_max({{'op': op, 'v': v}}, seq) AS x FROM l WHERE level = 1 GROUP BY k)
    SELECT k AS key, x.v AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)) WHERE x.op <> 'DELETE'"""
)
def kv_tier_mask(spark, sf_dir):
    r = M.event_runs(spark, sf_dir)
    return view.tiers(r.where("level = 0"), r.where("level = 1"))


@query(f"WITH {_BY_TYPE}, {_LATEST} SELECT split_part(key, ':', 1) AS event_type, count(*) AS n, max(value::BIGINT) AS newest FROM m GROUP BY 1")
def kv_view_sql(spark, sf_dir):
    """Plain SQL over a view: an extension."""
    return spark.sql(
        "SELECT split_part(key, ':', 1) AS event_type, count(*) AS n, max(CAST(value AS BIGINT)) AS newest FROM {v} GROUP BY 1", v=view.view(M.events_by_type(spark, sf_dir))
    )


# Compaction and runs.

_STORES: dict[tuple[str, str], str] = {}


def _stored(spark, sf_dir) -> str:
    """The runs of events in the shared folder, with ids that are no numbers; written once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORES:
        base = f"{folder(spark, 'store')}/runs"
        log = M.event_runs(spark, sf_dir)
        runs.write_runs(log.withColumn("run_id", F.concat(F.lit("run-"), F.hex(F.col("run_id").cast("long") * 37))), base, CONFIG)
        _STORES[at] = base
    return _STORES[at]


_STORED = f"{_RUNS.replace('l AS', 'l0 AS')}, l AS (SELECT k, v, seq, op, 'run-' || printf('%X', run_id * 37) AS run_id, level FROM l0)"


@query(f"WITH {_RUNS}, {_LATEST} SELECT key, op, value, seq FROM m")
def kv_compact_newest(spark, sf_dir):
    return compact.merge(M.event_runs(spark, sf_dir))


@query(
    f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (op = 'DELETE') DESC, run_id, seq DESC) AS rn FROM l)
    SELECT k AS key, op, v AS value, seq FROM r WHERE rn = 1"""
)
def kv_compact_tombstone_wins(spark, sf_dir):
    return compact.merge(M.event_runs(spark, sf_dir), compact.TOMBSTONE_WINS)


@query(
    f"""WITH {_STORED}, n AS (SELECT k, run_id, arg_max({{'op': op, 'v': v, 'seq': seq}}, seq) AS x FROM l GROUP BY k, run_id),
    r AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY (x.op = 'DELETE') DESC, run_id) AS rn FROM n)
    SELECT k AS key, x.op AS op, x.v AS value, x.seq AS seq FROM r WHERE rn = 1"""
)
def kv_compact_tombstone_stored(spark, sf_dir):
    """The same policy over runs as they are stored."""
    return compact.merge(runs.open_runs(spark, _stored(spark, sf_dir)), compact.TOMBSTONE_WINS)


@query(f"WITH {_RUNS}, {_LATEST} SELECT key, op, value, seq FROM m WHERE op <> 'DELETE'")
def kv_compact_purge(spark, sf_dir):
    return compact.merge(M.event_runs(spark, sf_dir), purge=True)


@query(
    f"""WITH {_RUNS}, f AS (SELECT level, run_id, row_number() OVER (PARTITION BY level ORDER BY run_id) - 1 AS k, count(*) OVER (PARTITION BY level) AS n
    FROM (SELECT DISTINCT level, run_id FROM l)) SELECT level, run_id, (k // 2)::BIGINT AS batch, level + 1 AS to_level FROM f WHERE level < 2 AND k // 2 < n // 2"""
)
def kv_compaction_plan(spark, sf_dir):
    return compact.plan(runs.manifest(M.event_runs(spark, sf_dir)), CONFIG.compaction_threshold, CONFIG.lsm_levels)


@query(
    f"""WITH {_RUNS} SELECT level, run_id, min(k) AS min_key, max(k) AS max_key, count(*) AS n, sum((op = 'DELETE')::BIGINT)::BIGINT AS n_deletes,
    sum(strlen(k) + strlen(v))::BIGINT AS bytes, min(seq) AS min_seq, max(seq) AS max_seq FROM l GROUP BY level, run_id"""
)
def run_manifest(spark, sf_dir):
    return runs.manifest(M.event_runs(spark, sf_dir))


_SUMMARY = f"""{_RUNS}, d AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY k) - 1 AS rn, count(*) OVER (PARTITION BY run_id) AS n
    FROM (SELECT DISTINCT run_id, k FROM l)), s AS (SELECT run_id, k AS key, rn::INT AS rn FROM d WHERE rn % 3 = 0 OR rn = n - 1)"""


@query(f"WITH {_SUMMARY} SELECT run_id, key, rn FROM s")
def run_sparse_summary(spark, sf_dir):
    return runs.sparse_summary(M.event_runs(spark, sf_dir), CONFIG.summary_step)


_PROBES = "p AS (SELECT DISTINCT event_type || ':' || lpad((user_id * 7 % 200)::VARCHAR, 6, '0') AS probe FROM events)"


@query(
    f"""WITH {_SUMMARY}, {_PROBES} SELECT s.run_id, probe, max(s.key) FILTER (s.key <= probe) AS summary_key FROM s, p
    GROUP BY s.run_id, probe HAVING probe BETWEEN min(s.key) AND max(s.key)"""
)
def run_summary_seek(spark, sf_dir):
    e = M.read(spark, sf_dir, "events")
    probes = e.select(F.concat("event_type", F.lit(":"), F.lpad((F.col("user_id") * 7 % 200).cast("string"), 6, "0")).alias("key"))
    return runs.summary_seek(runs.sparse_summary(M.event_runs(spark, sf_dir), CONFIG.summary_step), probes)


@query(f"WITH {_RUNS} SELECT level, count(DISTINCT run_id) AS n_runs, count(*) AS n, min(k) AS min_key, max(k) AS max_key, sum(strlen(k) + strlen(v))::BIGINT AS bytes FROM l GROUP BY level")
def run_stats(spark, sf_dir):
    return runs.stats(M.event_runs(spark, sf_dir))


@query(f"WITH {_STORED}, f AS (SELECT run_id, level, min(k) AS lo, max(k) AS hi FROM l GROUP BY run_id, level) SELECT level, run_id FROM f WHERE lo <= 'purchase:000050' AND hi >= 'purchase:000010'")
def run_pruning(spark, sf_dir):
    """Which runs a range needs, by the stored manifest: no run is read."""
    return runs.may_hold(runs.listed(spark, _stored(spark, sf_dir)), "purchase:000010", "purchase:000050").select("level", "run_id")


_NEWEST_RUNS = "n AS (SELECT level, run_id, k, arg_max({'v': v, 'op': op}, seq) AS x, max(seq) AS seq FROM l GROUP BY level, run_id, k)"


@query(
    f"""WITH {_STORED}, {_NEWEST_RUNS} SELECT level, run_id, min(k) AS min_key, max(k) AS max_key, count(*) AS n, sum((x.op = 'DELETE')::BIGINT)::BIGINT AS n_deletes,
    sum(strlen(k) + strlen(x.v))::BIGINT AS bytes, min(seq) AS min_seq, max(seq) AS max_seq FROM n GROUP BY level, run_id"""
)
def run_stored_manifest(spark, sf_dir):
    """The manifest as it was written with the runs."""
    return runs.listed(spark, _stored(spark, sf_dir)).select("level", "run_id", "min_key", "max_key", "n", "n_deletes", "bytes", "min_seq", "max_seq")


_FALSE_RATE = CONFIG.bloom_filter_false_positive_rate
_K = bloom.hashes_for(1_000_000, bloom.bits_for(1_000_000, _FALSE_RATE))
_KSEEDS = ", ".join(f"({i}, '{seed_hex(i)}')" for i in range(_K))


def _sized(n: str) -> str:
    """Bits of a filter for so many keys."""
    return f"greatest(ceil({n} * abs(ln({_FALSE_RATE})) / pow(ln(2), 2)), 1)::UBIGINT"


_PREFIX = "purchase:00014"


@query(
    f"""WITH {_STORED}, q(i, seed) AS (VALUES {_KSEEDS}), g AS (SELECT DISTINCT level, run_id, substr(k, 1, i) AS key FROM l, range(1, 11) r(i)),
    z AS (SELECT level, run_id, {_sized("count(*)")} AS m FROM g GROUP BY level, run_id),
    b AS (SELECT DISTINCT level, run_id, ('0x' || substr(md5(encode(key) || unhex(seed)), 1, 16))::UBIGINT % m AS bit FROM g JOIN z USING (level, run_id), q),
    o AS (SELECT level, run_id, min(k) AS lo, max(k) AS hi FROM l GROUP BY level, run_id),
    h AS (SELECT level, run_id, ('0x' || substr(md5(encode(substr('{_PREFIX}', 1, 10)) || unhex(seed)), 1, 16))::UBIGINT % m AS bit FROM z, q)
    SELECT level, run_id FROM o WHERE hi >= '{_PREFIX}' AND (lo <= '{_PREFIX}' OR starts_with(lo, '{_PREFIX}'))
    AND (level, run_id) NOT IN (SELECT (level, run_id) FROM h WHERE (level, run_id, bit) NOT IN (SELECT (level, run_id, bit) FROM b))"""
)
def run_gate_prefix(spark, sf_dir):
    """Which runs a prefix needs, by the stored bounds and prefix filters."""
    return runs.may_hold_prefix(runs.listed(spark, _stored(spark, sf_dir)), _PREFIX, CONFIG).select("level", "run_id")


@query(f"WITH {_STORED} SELECT DISTINCT level, run_id, run_id <> 'run-25' AS valid FROM l")
def run_validate(spark, sf_dir):
    """Stored roots against the rows, one of which is not what was written."""
    base = _stored(spark, sf_dir)
    rows = runs.open_runs(spark, base)
    spoilt = (F.col("run_id") == "run-25") & F.col("key").endswith("000007")
    return runs.invalid(runs.listed(spark, base), rows.withColumn("value", F.when(spoilt, F.concat("value", F.lit("?"))).otherwise(F.col("value"))))


_FOLD = """, o AS (SELECT u, seq, {cols}, row_number() OVER (PARTITION BY u ORDER BY seq) AS i FROM l)"""


@query(
    f"""WITH RECURSIVE {_BY_USER}{_FOLD.format(cols="strlen(k) + strlen(v) AS b")},
    t AS (SELECT u, i, seq, b AS size, 0 AS tab FROM o WHERE i = 1 UNION ALL
      SELECT o.u, o.i, o.seq, CASE WHEN t.size >= 200 THEN o.b ELSE t.size + o.b END, t.tab + (t.size >= 200)::INT FROM t JOIN o ON o.u = t.u AND o.i = t.i + 1)
    SELECT u AS "user", seq, tab::BIGINT AS memtable FROM t"""
)
def memtable_flush_points(spark, sf_dir):
    return runs.flush_points(M.events_by_user(spark, sf_dir), 200)


@query(
    f"""WITH RECURSIVE {_BY_TYPE}{_FOLD.format(cols="split_part(k, ':', 1) AS k")},
    t AS (SELECT u, i, seq, FALSE AS hit, [k] AS held FROM o WHERE i = 1 UNION ALL
      SELECT o.u, o.i, o.seq, list_contains(t.held, o.k), list_concat([o.k], list_filter(t.held, lambda x: x <> o.k))[1:3] FROM t JOIN o ON o.u = t.u AND o.i = t.i + 1)
    SELECT u AS "user", seq, hit FROM t"""
)
def lru_replay(spark, sf_dir):
    log = M.events_by_type(spark, sf_dir)
    return cache.lru_replay(log.select("user", "seq", F.substring_index("key", ":", 1).alias("key")), 3)


# The write-ahead log.


def _le(n: str) -> str:
    return " || ".join(f"printf('%02X', ({n} >> {8 * i}) & 255)" for i in range(8))


@query(
    f"""WITH {_BY_USER} SELECT seq, {_le("secs")} || CASE WHEN op = 'DELETE' THEN '01' ELSE '00' END || {_le("strlen(k)")} || {_le("strlen(v)")} || hex(encode(k)) || hex(encode(v)) AS payload,
    (29 + strlen(k) + strlen(v))::INT AS bytes FROM l"""
)
def wal_encode(spark, sf_dir):
    r = wal.encode(M.events_by_user(spark, sf_dir))
    return r.select("seq", F.substring(F.hex("record"), 9, 1 << 30).alias("payload"), F.octet_length("record").alias("bytes"))


@query(f"WITH {_BY_USER} SELECT seq, secs AS ts, u AS \"user\", op, k AS key, v AS value, TRUE AS valid FROM l")
def wal_decode(spark, sf_dir):
    return wal.decode(wal.encode(M.events_by_user(spark, sf_dir)))


@query(f"WITH {_BY_USER}, {_LATEST} SELECT key, value FROM m WHERE op <> 'DELETE'")
def wal_replay(spark, sf_dir):
    return wal.replay(wal.encode(M.events_by_user(spark, sf_dir)))


@query(
    f"""WITH {_BY_USER}, b AS (SELECT u, seq, 29 + strlen(k) + strlen(v) AS bytes FROM l)
    SELECT u AS "user", seq, bytes::BIGINT AS bytes, (coalesce(sum(bytes) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000)::BIGINT AS segment FROM b"""
)
def wal_segments(spark, sf_dir):
    return wal.segments(M.events_by_user(spark, sf_dir), CONFIG.wal_segment_size)


_CUT = 1705276800000000


@query(f"WITH {_BY_USER} SELECT seq, op, k AS key, v AS value FROM l WHERE seq > {_CUT}")
def wal_truncate(spark, sf_dir):
    return wal.truncate(M.events_by_user(spark, sf_dir), _CUT).select("seq", "op", "key", "value")


@query(f"WITH {_BY_USER}, {_LATEST} SELECT key, value FROM m WHERE op <> 'DELETE'")
def stream_ingest(spark, sf_dir):
    """The log as a stream, written as runs by micro-batches, and the view of those runs."""
    base = folder(spark, "stream")
    # A pattern, as a stream takes one for a file and for a folder alike.
    events = spark.readStream.schema(M.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    ingest.into_runs(M.user_log(events), f"{base}/runs", f"{base}/progress").awaitTermination()
    return view.view(runs.open_runs(spark, f"{base}/runs"))


# Sketches.

_P = hll.precision(0.01)
_REGISTERS = f"""h AS (SELECT ('0x' || substr(md5(l_partkey::VARCHAR), 1, 16))::UBIGINT AS h FROM lineitem WHERE l_partkey IS NOT NULL),
    w AS (SELECT (h >> {64 - _P})::INT AS idx, ((h::UHUGEINT << {_P}) & 18446744073709551615::UHUGEINT)::UBIGINT | {1 << (_P - 1)}::UBIGINT AS w FROM h),
    r AS (SELECT idx, max(65 - length(ltrim(bin(w), '0')))::INT AS rank FROM w GROUP BY idx)"""


@query(f"WITH {_REGISTERS} SELECT idx, rank FROM r")
def hll_registers(spark, sf_dir):
    return hll.registers(M.read(spark, sf_dir, "lineitem"), F.col("l_partkey"), _P)


_M = 1 << _P


@query(
    f"""WITH {_REGISTERS}, a AS (SELECT coalesce(sum(pow(2.0, -rank)), 0) AS s, count(*) AS n FROM r), e AS (SELECT {hll.alpha(_M) * _M * _M!r} / (s + ({_M} - n)) AS raw, {_M} - n AS zeros FROM a)
    SELECT floor(CASE WHEN raw <= {2.5 * _M} AND zeros > 0 THEN {_M} * ln({_M}.0::DOUBLE / zeros) WHEN raw > 4294967296.0 / 30 THEN -4294967296.0 * ln(1 - raw / 4294967296.0) ELSE raw END)::BIGINT AS estimate FROM e"""
)
def hll_estimate(spark, sf_dir):
    return hll.estimate(hll.registers(M.read(spark, sf_dir, "lineitem"), F.col("l_partkey"), _P), _P)


@query(f"WITH {_REGISTERS} SELECT '{_P:02X}{_M:08X}' || string_agg(printf('%02X', coalesce(rank, 0)), '' ORDER BY i) AS sketch FROM range(0, {_M}) z(i) LEFT JOIN r ON r.idx = i")
def hll_serialize(spark, sf_dir):
    return serial.hll_bytes(hll.registers(M.read(spark, sf_dir, "lineitem"), F.col("l_partkey"), _P), _P).select(F.hex("sketch").alias("sketch"))


_EPS, _DELTA = 0.01, 0.01
_W, _D = cms.width(_EPS), cms.depth(_DELTA)
_SEEDS = ", ".join(f"({i}, '{seed_hex(i)}')" for i in range(_D))
_CELLS = f"""{_BY_TYPE}, q(i, seed) AS (VALUES {_SEEDS}), c AS (SELECT k, i, (('0x' || substr(md5(encode(k) || unhex(seed)), 1, 16))::UBIGINT % {_W})::INT AS col FROM l, q),
    t AS (SELECT i AS row, col, count(*) AS n FROM c GROUP BY i, col)"""


@query(f"WITH {_CELLS} SELECT row, col, n FROM t")
def cms_cells(spark, sf_dir):
    return cms.cells(M.events_by_type(spark, sf_dir), F.col("key"), _EPS, _DELTA)


@query(f"WITH {_CELLS} SELECT k AS item, min(n) AS estimate FROM (SELECT DISTINCT k, i, col FROM c) d JOIN t ON t.row = d.i AND t.col = d.col GROUP BY k")
def cms_estimate(spark, sf_dir):
    log = M.events_by_type(spark, sf_dir)
    return cms.estimate(cms.cells(log, F.col("key"), _EPS, _DELTA), log.select(F.col("key").alias("item")), _EPS, _DELTA)


@query(
    f"WITH {_CELLS} SELECT '434D533101{_W:08X}{_D:08X}' || string_agg(printf('%016X', coalesce(n, 0)), '' ORDER BY z.i) AS sketch FROM range(0, {_W * _D}) z(i) LEFT JOIN t ON t.row * {_W} + t.col = z.i"
)
def cms_serialize(spark, sf_dir):
    return serial.cms_bytes(cms.cells(M.events_by_type(spark, sf_dir), F.col("key"), _EPS, _DELTA), _W, _D).select(F.hex("sketch").alias("sketch"))


_NATIONS = 25
_BM = bloom.bits_for(_NATIONS, 0.01)
_BK = bloom.hashes_for(_NATIONS, _BM)
_BSEEDS = ", ".join(f"({i}, '{seed_hex(i)}')" for i in range(_BK))


def _hit(x: str, m: int | str) -> str:
    return f"(('0x' || substr(md5(encode({x}) || unhex(seed)), 1, 16))::UBIGINT % {m})"


@query("SELECT n, ceil(n * abs(ln(0.01)) / pow(ln(2), 2))::BIGINT AS m, ceil(ceil(n * abs(ln(0.01)) / pow(ln(2), 2)) / n * ln(2))::BIGINT AS k FROM (SELECT count(*) AS n FROM nation)")
def bloom_params(spark, sf_dir):
    n = M.read(spark, sf_dir, "nation").agg(F.count("*").alias("n"))
    m = F.ceil(F.col("n") * F.abs(F.log(F.lit(0.01))) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))
    return n.select("n", m.cast("long").alias("m"), F.ceil(m / F.col("n") * F.log(F.lit(2.0))).cast("long").alias("k"))


_BLOOM = f"""q(i, seed) AS (VALUES {_BSEEDS}), b AS (SELECT DISTINCT {_hit("n_name", _BM)} AS bit FROM nation, q),
    p AS (SELECT n_name AS key FROM nation UNION SELECT c_name FROM customer),
    c AS (SELECT key, bool_and({_hit("key", _BM)} IN (SELECT bit FROM b)) AS present FROM p, q GROUP BY key)"""


def _checked(spark, sf_dir):
    nations = M.read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"))
    probes = nations.unionByName(M.read(spark, sf_dir, "customer").select(F.col("c_name").alias("key")))
    return bloom.check(bloom.build(nations, _BM, _BK), probes, _BM, _BK)


@query(f"WITH {_BLOOM} SELECT key, present FROM c")
def bloom_check(spark, sf_dir):
    return _checked(spark, sf_dir)


@query(f"WITH {_BLOOM} SELECT count(*) AS n_absent, sum(present::INT)::BIGINT AS n_false FROM c WHERE key NOT IN (SELECT n_name FROM nation)")
def bloom_false_positive_rate(spark, sf_dir):
    nations = M.read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"))
    absent = _checked(spark, sf_dir).join(nations, "key", "left_anti")
    return absent.agg(F.count("*").alias("n_absent"), F.sum(F.col("present").cast("long")).alias("n_false"))


# A filter a run decides which of them a point read must open.
@query(
    f"""WITH {_RUNS}, q(i, seed) AS (VALUES {_KSEEDS}), o AS (SELECT run_id, min(k) AS lo, max(k) AS hi, {_sized("count(DISTINCT k)")} AS m FROM l GROUP BY run_id),
    b AS (SELECT DISTINCT run_id, ('0x' || substr(md5(encode(k) || unhex(seed)), 1, 16))::UBIGINT % m AS bit FROM l JOIN o USING (run_id), q),
    p AS (SELECT DISTINCT event_type || ':' || lpad((user_id * 7 % 500)::VARCHAR, 6, '0') AS key FROM events),
    h AS (SELECT DISTINCT run_id, key, ('0x' || substr(md5(encode(key) || unhex(seed)), 1, 16))::UBIGINT % m AS bit FROM p JOIN o ON key BETWEEN lo AND hi, q),
    n AS (SELECT run_id, key, count(*) AS need FROM h GROUP BY run_id, key)
    SELECT run_id, key FROM h JOIN b USING (run_id, bit) JOIN n USING (run_id, key) GROUP BY run_id, key, need HAVING count(*) = need"""
)
def run_bloom_gate(spark, sf_dir):
    e = M.read(spark, sf_dir, "events")
    probes = e.select(F.concat("event_type", F.lit(":"), F.lpad((F.col("user_id") * 7 % 500).cast("string"), 6, "0")).alias("key"))
    r = M.event_runs(spark, sf_dir)
    bounds = r.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return bloom.gate(bloom.packed(r, _FALSE_RATE, runs.STORED_BITS, "run_id").join(bounds, "run_id"), "run_id", probes, _K)


_PREFIXES = "g AS (SELECT DISTINCT substr(p_name, 1, i) AS key FROM part, range(1, 11) r(i) WHERE i <= length(p_name))"


@query(f"WITH {_PREFIXES} SELECT length(key)::INT AS size, count(*) AS n FROM g GROUP BY 1")
def prefix_bloom_fanout(spark, sf_dir):
    keys = view.latest(M.parts(spark, sf_dir)).select("key")
    p = bloom.prefixes(keys, CONFIG.min_prefix_length, CONFIG.max_prefix_length)
    return p.groupBy(F.length("key").alias("size")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PREFIXES}, q(i, seed) AS (VALUES {_KSEEDS}), z AS (SELECT {_sized("count(*)")} AS m FROM g), b AS (SELECT DISTINCT {_hit("key", "(SELECT m FROM z)")} AS bit FROM g, q),
    p AS (SELECT DISTINCT n_name AS key FROM nation UNION SELECT substr(p_name, 2) FROM part UNION SELECT p_name FROM part UNION SELECT '')
    SELECT key, CASE WHEN key = '' THEN TRUE ELSE bool_and({_hit("substr(key, 1, 10)", "(SELECT m FROM z)")} IN (SELECT bit FROM b)) END AS present FROM p, q GROUP BY key"""
)
def prefix_bloom_contains(spark, sf_dir):
    parts, nation = M.read(spark, sf_dir, "part"), M.read(spark, sf_dir, "nation")
    held = bloom.prefixes(parts.select(F.col("p_name").alias("key")).distinct(), 1, 10)
    m = bloom.bits_for(held.count(), _FALSE_RATE)
    probes = nation.select(F.col("n_name").alias("key"))
    for c in (F.expr("substr(p_name, 2)"), F.col("p_name"), F.lit("")):
        probes = probes.unionByName(parts.select(c.alias("key")))
    return bloom.check_prefixes(bloom.build(held, m, _K), probes, m, _K, 1, 10)


_SIM = """k AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS t FROM documents),
    h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM k),
    v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, range(0, 64) r(i) GROUP BY doc_id, i),
    b AS (SELECT doc_id, bit_or(CASE WHEN s > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS hash FROM v GROUP BY doc_id),
    s AS (SELECT doc_id, coalesce(hash, 0::UBIGINT) AS hash FROM documents LEFT JOIN b USING (doc_id))"""


def _hashed(spark, sf_dir):
    docs = spread(M.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return simhash.simhash(docs, "doc_id", simhash.tokens(F.col("text")))


@query(f"WITH {_SIM} SELECT doc_id, lower(lpad(hex(hash), 16, '0')) AS hash FROM s")
def simhash_docs(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", simhash.hex16(F.col("hash")).alias("hash"))


_REPS = f"{_SIM}, c AS (SELECT hash, min(doc_id) AS rep, count(*) AS n FROM s GROUP BY hash)"


@query(f"WITH {_REPS} SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.hash, y.hash))::INT AS distance FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.hash, y.hash)) <= 3")
def hamming_pairs(spark, sf_dir):
    return simhash.near_pairs(simhash.classes(_hashed(spark, sf_dir), "doc_id")).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query(
    f"""WITH {_REPS}, p AS (SELECT x.rep, sum(y.n)::BIGINT AS others FROM c x JOIN c y ON x.rep <> y.rep AND bit_count(xor(x.hash, y.hash)) <= 3 GROUP BY x.rep)
    SELECT doc_id, c.rep AS class_id, (c.n - 1 + coalesce(others, 0))::BIGINT AS n_links FROM s JOIN c USING (hash) LEFT JOIN p ON p.rep = c.rep"""
)
def near_duplicates(spark, sf_dir):
    return simhash.links(_hashed(spark, sf_dir), "doc_id")


@query("SELECT count(DISTINCT l_partkey) AS exact, TRUE AS approx_near, TRUE AS sketch_near FROM lineitem")
def approx_distinct_native(spark, sf_dir):
    """The built-in sketches beside the exact number, each within 10 percent."""
    n = M.read(spark, sf_dir, "lineitem").agg(
        F.countDistinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("sketch")
    )
    near = lambda c: (F.abs(F.col(c) - F.col("exact")) <= 0.1 * F.col("exact")).alias(f"{c}_near")
    return n.select("exact", near("approx"), near("sketch"))


# A serialized sketch of that kind, big-endian: version i32, all items i64, depth i32, width i32, depth hash seeds i64, cells i64.
@query(f"WITH {_BY_TYPE} SELECT count(*) AS n, count(*) AS first_row, ceil(2 / {_EPS})::BIGINT AS width FROM l")
def cms_native(spark, sf_dir):
    """The built-in Count-Min sketch: its number of items, the sum of its first row, and its width."""
    one = M.events_by_type(spark, sf_dir).agg(F.count_min_sketch("key", F.lit(_EPS), F.lit(1 - _DELTA), F.lit(1)).alias("b"))
    number = lambda at, size: f"CAST(conv(hex(substring(b, {at}, {size})), 16, -10) AS BIGINT)"
    head = one.selectExpr("b", f"{number(5, 8)} AS n", f"{number(13, 4)} AS depth", f"{number(17, 4)} AS width")
    cell = number("CAST(21 + 8 * depth + 8 * i AS INT)", "8")
    row = f"aggregate(transform(sequence(0, CAST(width AS INT) - 1), i -> {cell}), 0L, (a, x) -> a + x)"
    return head.selectExpr("n", f"{row} AS first_row", "width")


# Integrity.


_LINE_KEY = "lpad(l_orderkey::VARCHAR, 12, '0') || ':' || lpad(l_linenumber::VARCHAR, 3, '0') || ':' || lpad(l_partkey::VARCHAR, 12, '0') || ':' || lpad(l_suppkey::VARCHAR, 12, '0')"
_LINES = f"i AS (SELECT {_LINE_KEY} AS k, max(l_orderkey * 1000 + l_linenumber)::VARCHAR AS v FROM lineitem GROUP BY 1)"
_LINE_LEAF = "SELECT 0 AS run, row_number() OVER (ORDER BY k) - 1 AS pos, sha256(v) AS hash FROM i"


def _lines(spark, sf_dir):
    """A run of as many keys as lineitem has."""
    parts = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_orderkey", 12), ("l_linenumber", 3), ("l_partkey", 12), ("l_suppkey", 12))]
    rows = M.read(spark, sf_dir, "lineitem").groupBy(F.concat_ws(":", *parts).alias("key"))
    return rows.agg(F.max(F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("string").alias("value"))


@query(f"WITH {_LINES}, t AS ({_LINE_LEAF}) SELECT pos, hash FROM t")
def merkle_leaves(spark, sf_dir):
    return integrity.leaves(_lines(spark, sf_dir))


def _tree_sql(leaf: str, depth: int) -> str:
    out = [f"t0 AS ({leaf})"]
    for i in range(depth):
        out.append(
            f"t{i + 1} AS (SELECT run, pos // 2 AS pos, sha256(max(hash) FILTER (pos % 2 = 0) || coalesce(max(hash) FILTER (pos % 2 = 1), '')) AS hash FROM t{i} GROUP BY run, pos // 2 HAVING max((SELECT max(pos) FROM t{i} z WHERE z.run = t{i}.run)) > 0)"
        )
    return ", ".join(out)


def _tree_nodes(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT run, {i} AS level, pos, hash FROM t{i}" for i in range(depth + 1))


_DEPTH = 20  # enough for a million leaves; levels above a root are empty


@query(f"WITH {_LINES}, {_tree_sql(_LINE_LEAF, _DEPTH)}, a AS ({_tree_nodes(_DEPTH)}) SELECT (SELECT count(*) FROM t0) AS n_leaves, hash AS root FROM a WHERE level = (SELECT max(level) FROM a)")
def merkle_root(spark, sf_dir):
    return integrity.root(integrity.leaves(_lines(spark, sf_dir)))


@query(f"WITH {_LINES}, {_tree_sql(_LINE_LEAF, _DEPTH)}, a AS ({_tree_nodes(_DEPTH)}) SELECT level, pos, hash FROM a WHERE level > 0")
def merkle_nodes(spark, sf_dir):
    return integrity.levels(integrity.leaves(_lines(spark, sf_dir))).where("level > 0")


_RUN_LEAF = f"SELECT run_id AS run, row_number() OVER (PARTITION BY run_id ORDER BY k) - 1 AS pos, sha256(x.v) AS hash FROM (SELECT run_id, k, arg_max({{'v': v}}, seq) AS x FROM l GROUP BY run_id, k)"


@query(
    f"""WITH {_RUNS}, {_tree_sql(_RUN_LEAF, 14)}, a AS ({_tree_nodes(14)}), n AS (SELECT run, count(*) AS n_leaves FROM t0 GROUP BY run)
    SELECT a.run AS run_id, n_leaves, hash AS root FROM a JOIN n USING (run) WHERE pos = 0 AND level = (SELECT max(level) FROM a z WHERE z.run = a.run)"""
)
def merkle_run_roots(spark, sf_dir):
    """A root for each run, over its newest versions."""
    r = M.event_runs(spark, sf_dir)
    newest = r.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return integrity.root(integrity.leaves(newest, "run_id"), "run_id")


_SPOILT = _LINE_LEAF.replace("sha256(v)", "sha256(CASE WHEN v::BIGINT % 4999 = 7 THEN 'changed' ELSE v END)")


@query(
    f"""WITH {_LINES}, a AS (WITH {_tree_sql(_LINE_LEAF, _DEPTH)} SELECT * FROM ({_tree_nodes(_DEPTH)})), b AS (WITH {_tree_sql(_SPOILT, _DEPTH)} SELECT * FROM ({_tree_nodes(_DEPTH)}))
    SELECT coalesce(a.level, b.level) AS level, coalesce(a.pos, b.pos) AS pos, a.hash AS hash_a, b.hash AS hash_b FROM a FULL JOIN b ON a.level = b.level AND a.pos = b.pos WHERE a.hash IS DISTINCT FROM b.hash"""
)
def merkle_diff(spark, sf_dir):
    old = _lines(spark, sf_dir)
    new = old.withColumn("value", F.when(F.col("value").cast("long") % 4999 == 7, "changed").otherwise(F.col("value")))
    return integrity.diff(*[written(integrity.levels(integrity.leaves(x)), "nodes") for x in (old, new)])


# The rate limiter.

_CAP, _RATE = 3, 1 / 43200


def _bucket_sql(strict: bool) -> str:
    added = f"floor((o.secs - t.t0)::DOUBLE * {_RATE!r}::DOUBLE)::BIGINT"
    now = f"least(t.tokens + {added}, {_CAP})"
    refused = now if strict else "t.tokens"
    t0 = f"CASE WHEN {added} > 0 THEN o.secs ELSE t.t0 END" if strict else "t.t0"
    return f"""WITH RECURSIVE {_BY_USER}{_FOLD.format(cols="secs")},
    t AS (SELECT u, i, seq, TRUE AS allowed, ({_CAP} - 1)::BIGINT AS tokens, secs AS t0 FROM o WHERE i = 1 UNION ALL
      SELECT o.u, o.i, o.seq, {now} >= 1, CASE WHEN {now} >= 1 THEN {now} - 1 ELSE {refused} END, {t0} FROM t JOIN o ON o.u = t.u AND o.i = t.i + 1)
    SELECT u AS "user", seq, allowed, tokens FROM t"""


@query(_bucket_sql(False))
def token_bucket_replay(spark, sf_dir):
    return limiter.replay(M.events_by_user(spark, sf_dir), _CAP, _RATE)


@query(_bucket_sql(True))
def token_bucket_strict(spark, sf_dir):
    return limiter.replay(M.events_by_user(spark, sf_dir), _CAP, _RATE, strict=True)
