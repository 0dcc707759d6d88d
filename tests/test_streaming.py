import pytest

from sediment.operators import limiter, runs, view
from sediment.schema import MUTATION
from sediment.streaming import ingest


def test_micro_batches_become_runs(spark, tmp_path):
    src, base, ck = (str(tmp_path / x) for x in ("src", "runs", "ck"))
    rows = [(i, None, "u", "DELETE" if i % 7 == 0 else "PUT", f"k{i % 20}", "" if i % 7 == 0 else f"v{i}") for i in range(100)]
    for cut in (rows[60:], rows[:60]):  # the newer rows arrive first
        spark.createDataFrame(cut, MUTATION).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 1).parquet(src)
        assert ingest.into_runs(stream, base, ck).awaitTermination(120)
    d = runs.open_runs(spark, base)
    assert d.select("run_id").distinct().count() == 2
    truth = {}
    for *_, op, k, v in rows:
        truth[k] = v if op == "PUT" else None
    assert {r.key: r.value for r in view.view(d).collect()} == {k: v for k, v in truth.items() if v is not None}


def test_stateful_limiter_matches_the_replay(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = [("ab"[i % 2], i, i * 9) for i in range(60)]
    schema = "user string, seq long, ts long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for cut in (rows[:25], rows[25:]):
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = ingest.limited(stream, 2, 0.05).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    want = limiter.replay(spark.createDataFrame(rows, schema), 2, 0.05).select("user", "seq", "allowed", "tokens")
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {tuple(r) for r in want.collect()}
