import pytest
from tonestream.streaming import carry


def write(spark, rows, path, n):
    spark.createDataFrame(rows, "sid long, idx long, v double").coalesce(1).write.mode("append").parquet(f"{path}/{n}")


def test_state_is_carried_between_batches(spark, tmp_path):
    rows = [(s, i, float((i * 7 + s) % 5)) for s in (1, 2) for i in range(20)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, (a, b) in enumerate(((0, 8), (8, 20))):
        write(spark, [r for r in rows if a <= r[1] < b], src, n)
        df = spark.readStream.schema("sid long, idx long, v double").option("recursiveFileLookup", "true").parquet(src)
        q = carry.stream_remove_dc(df, 0.9).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.sid, r.idx): r.v for r in spark.read.parquet(out).collect()}
    want = {(r.sid, r.idx): r.v for r in carry.remove_dc(spark.createDataFrame(rows, "sid long, idx long, v double"), 0.9).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
