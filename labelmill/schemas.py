"""Declared schemas. A corpus read never infers its types."""

from pyspark.sql import types as T

SAMPLES = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]
)

# Where a row stands inside its source. Struct ordering is lexicographic, so a file
# source fills all three fields and a table with a row number only the last one or two.
ORD = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("major", T.LongType()),
        T.StructField("minor", T.LongType()),
    ]
)

SAMPLES_IN_ORDER = T.StructType([*SAMPLES.fields, T.StructField("ord", ORD)])

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

ERRORS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("true_label", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("confidence_pct", T.DoubleType()),
        T.StructField("true_class_prob", T.DoubleType()),
    ]
)
