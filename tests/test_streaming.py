from quarterlight.streaming import incremental


def test_incremental_upsert(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, at int, v string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema).coalesce(1).write.parquet(source)

    def once():
        stream = incremental.page_stream(spark, source, schema)
        stream.writeStream.foreachBatch(incremental.upserting(sink, "id", "at")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)

    once()
    spark.createDataFrame([("a", 0, "late"), ("c", 1, "n")], schema).coalesce(1).write.mode("append").parquet(source)
    once()
    got = {r["id"]: r["v"] for r in incremental.current(spark, sink, "id", "at").collect()}
    assert got == {"a": "late", "b": "z", "c": "n"}
