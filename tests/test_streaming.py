import pytest

from docloom.context import SpecError
from docloom.streaming import read_stream, stream, windowed_group

SF = "/root/testdata/sf0.001"


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_row_stages(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    source = read_stream(spark, f"{tmp_path}/e")
    out = drained(spark, stream(source, [{"$match": {"value": {"$gt": 50}}}, {"$project": {"_id": 0, "event_id": 1, "twice": {"$multiply": ["$value", 2]}}}]), "rows")
    assert out.count() == events.filter("value > 50").count()
    with pytest.raises(SpecError):
        stream(source, [{"$sort": {"value": 1}}])


def test_windowed_group(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    source = read_stream(spark, f"{tmp_path}/e")
    out = drained(spark, windowed_group(source, "ts", "1 day", "1 hour", ["event_type"], {"n": {"$sum": 1}, "v": {"$avg": "$value"}}), "groups", "complete")
    assert out.agg({"n": "sum"}).first()[0] == events.count()
    with pytest.raises(SpecError):
        windowed_group(source, "ts", "1 day", "1 hour", [], {"x": {"$push": "$value"}})
