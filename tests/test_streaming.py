import pytest
from pyspark.sql import functions as F

from scriptorium.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.mode("overwrite").parquet(path)
    schema = spark.read.parquet(path).schema
    return lambda **o: spark.readStream.schema(schema).options(**o).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_first_requests(spark, stream):
    got = run(jobs.first_requests(stream(), "60 days"), "first_requests")
    want = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct().count()
    assert got.count() == want


def test_heartbeats_complete(spark, stream):
    got = run(jobs.heartbeats(stream(), "60 days"), "beats", "complete")
    assert got.agg(F.sum("beats")).first()[0] == 1000


def test_leases_have_one_holder(spark, stream):
    got = run(jobs.leases(stream()), "leases").toPandas().sort_values("event_id")
    ts = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")).toPandas().set_index("event_id").t
    for _, g in got.groupby("job"):
        holder, until = None, 0
        for r in g.itertuples():
            ok = holder is None or holder == r.worker or until <= ts[r.event_id]
            assert ok == r.granted
            if ok:
                holder, until = r.worker, ts[r.event_id] + jobs.LEASE_SECONDS


def test_upsert_keeps_latest(spark, stream, tmp_path):
    out = str(tmp_path / "state")
    q = stream(maxFilesPerTrigger=1).writeStream.foreachBatch(jobs.upsert_into(out, "user_id", "event_id")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if p.name.startswith("epoch"))
    got = {r.user_id: r.event_id for r in spark.read.parquet(f"{out}/epoch={last}").collect()}
    want = {r.user_id: r.e for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    assert got == want
