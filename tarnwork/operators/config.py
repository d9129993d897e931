"""The embedding model named in a configuration text, and whether it suits English or code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
KEY = r"(?U)model_name:\s*([^\s#]+)"
REJECTED, EXCEPT = "zh", "-ft"
ACCEPTED = ("en", "code", "minilm")


def model_name(text: Column) -> Column:
    """The first value of the key, wherever it stands; null without one."""
    return F.nullif(F.regexp_extract(text, KEY, 1), F.lit(""))


def classify(name: Column) -> Column:
    """PASS or FAIL of a model name."""
    low = F.lower(name)
    accepted = F.lit(False)
    for k in ACCEPTED:
        accepted = accepted | F.contains(low, F.lit(k))
    return F.when(name.isNull(), "FAIL").when(F.contains(low, F.lit(REJECTED)) & ~F.contains(low, F.lit(EXCEPT)), "FAIL").when(accepted, "PASS").otherwise("FAIL")


def check_configs(configs: DataFrame) -> DataFrame:
    """configs (path, value) as (path, model_name, status, reason). A null value stands for a config that wasn't found: SKIP."""
    name = model_name(F.col("value"))
    low = F.lower(name)
    status = F.when(F.col("value").isNull(), "SKIP").otherwise(classify(name))
    reason = (
        F.when(F.col("value").isNull(), "no config found")
        .when(name.isNull(), "no model_name")
        .when(F.contains(low, F.lit(REJECTED)) & ~F.contains(low, F.lit(EXCEPT)), F.concat(F.lit("model for Chinese: "), name))
        .when(status == "PASS", F.concat(F.lit("model: "), name))
        .otherwise(F.concat(F.lit("unknown kind of model: "), name))
    )
    return configs.select("path", name.alias("model_name"), status.alias("status"), reason.alias("reason"))
