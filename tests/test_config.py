import pytest
from pyspark.sql import functions as F

from tarnwork.operators import config
from tarnwork.sources import first_existing, first_of_places, parameter, parent_root, placed_texts, whole_texts, write_placed


@pytest.mark.parametrize(
    "text,name",
    [
        ("# model_name: old\nmodel_name: new", "old"),
        ("llm_model_name: q7", "q7"),
        ("model_name:\n  dim: 3", "dim:"),
        ('model_name: "x-en"', '"x-en"'),
        ("model_name: # note", None),
        ("name: x", None),
        ("model_name:　wide", "wide"),
        ("", None),
    ],
)
def test_model_name(spark, text, name):
    assert spark.range(1).select(config.model_name(F.lit(text)).alias("n")).first().n == name


@pytest.mark.parametrize(
    "name,status",
    [("org/small-en", "PASS"), ("org/small-ZH", "FAIL"), ("out/small-zh-ft", "FAIL"), ("out/zh-ft-code", "PASS"), ("e5-small", "FAIL"), ("patent/zh-ft", "PASS"), ("all-MiniLM-L6", "PASS"), (None, "FAIL")],
)
def test_classes(spark, name, status):
    assert spark.range(1).select(config.classify(F.lit(name).cast("string")).alias("s")).first().s == status


def test_files_and_missing_config(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/c.yaml").write_text("model_name: a-en\n", encoding="utf-8")
    found = first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "p")], "c.yaml")
    assert found and first_existing(spark, [str(tmp_path)], "c.yaml") is None
    row = config.check_configs(whole_texts(spark, found)).first()
    assert (row.model_name, row.status) == ("a-en", "PASS")
    none = spark.createDataFrame([("x", None)], "path string, value string")
    assert config.check_configs(none).first().status == "SKIP"


def test_parameters(spark, monkeypatch):
    monkeypatch.setenv("SOME_PATH", "there")
    assert parameter(spark, "SOME_PATH", "default") == "there"
    assert parameter(spark, "SOME_OTHER_PATH", "default") == "default"
    assert parent_root("/a/b/c.py") == "/a"


def test_placed_texts_of_many_cases_lie_in_few_files(spark, tmp_path):
    """The text at the lowest place wins; line breaks, empty and null texts come back as they are; cases don't make files."""
    odd = {0: "a: 1\r\nb: \u2028\"x\"\n", 1: "", 2: None}
    texts = spark.createDataFrame([(i, p, odd.get(i, f"{p}/{i}\n")) for i in range(400) for p in (0, 1) if (i + p) % 5], "case long, place int, value string")
    write_placed(texts.repartition(3), f"file://{tmp_path}/placed")
    assert len(list(tmp_path.rglob("*.json"))) <= 6
    got = {r.case: r.value for r in first_of_places(placed_texts(spark, f"file://{tmp_path}/placed"), spark.range(401).toDF("case")).collect()}
    assert got == {i: odd.get(i, f"{0 if i % 5 else 1}/{i}\n") for i in range(400)} | {400: None}
    write_placed(texts.limit(0), f"file://{tmp_path}/none")
    assert placed_texts(spark, f"file://{tmp_path}/none").count() == 0
