"""Schemas of the stored relations."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
COORDINATES = T.StructType([T.StructField("start", POINT), T.StructField("end", POINT)])

FILE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("last_modified_ns", T.LongType()),
    T.StructField("sha256_digest", T.BinaryType()),
])
SCAN = T.StructType([*FILE.fields[:3], T.StructField("content", T.BinaryType())])
OBJECT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("context_before", T.ArrayType(T.IntegerType())),
    T.StructField("context_after", T.ArrayType(T.IntegerType())),
    T.StructField("byte_range", SPAN),
    T.StructField("coordinates", COORDINATES),
    T.StructField("content", T.StringType()),
    T.StructField("content_sha256", T.StringType()),  # of the rendered text, by which vectors are found
])
EMBEDDING = T.StructType([
    T.StructField("content_sha256", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("data", T.ArrayType(T.FloatType())),
])
POSTING = T.StructType([T.StructField("gram", T.StringType(), False), T.StructField("object_id", T.LongType(), False)])
