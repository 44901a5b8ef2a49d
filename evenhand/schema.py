"""Keys, fixed values and record layout of paired counterfactual decisions."""

from pyspark.sql import types as T

# The six conditions in order, the reference condition, the seed, the significance level.
GROUPS = ("white_male", "black_male", "hispanic_male", "white_female", "black_female", "hispanic_female")
REFERENCE = "white_male"
SEED = 20260612
LEVEL = 0.05

CELL = ["domain", "scaffold", "model"]
SET = [*CELL, "profile_id"]

DECISION = T.StructType(
    [T.StructField("ord", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("domain", "scaffold", "model", "profile_id", "group", "name")]
    + [T.StructField("action", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("tool_request", T.BooleanType()), T.StructField("raw", T.StringType())]
)
PROFILE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "domain", "title", "content", "difficulty", "content_sha256_16")])
TRACE = "model string, domain string, scaffold string, profile_id string, `group` string, name string, decision string"
