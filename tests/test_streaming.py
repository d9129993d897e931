from tarnwork.streaming import read_texts, watch_configs, watch_terms


def drain(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("model_name: x-en\n")
    (tmp_path / "b.yaml").write_text("other: 1\n")
    got = drain(watch_configs(spark, str(tmp_path)), "watched", spark)
    assert sorted(r.status for r in got.collect()) == ["FAIL", "PASS"]
    hits = drain(watch_terms(read_texts(spark, str(tmp_path)), "other", "value"), "hits", spark)
    assert [r.path.rsplit("/", 1)[-1] for r in hits.collect()] == ["b.yaml"]
