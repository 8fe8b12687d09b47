"""Types of what comes in and goes out."""

from __future__ import annotations

from pyspark.sql import types as T

TOKEN = T.StructType([T.StructField("value", T.StringType(), False), T.StructField("position", T.IntegerType()), T.StructField("weight", T.IntegerType())])
FIELD = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("tokenCount", T.StringType()),
        T.StructField("indexable", T.BooleanType()),
        T.StructField("tokens", T.ArrayType(TOKEN, False)),
        T.StructField("payload", T.IntegerType()),
    ]
)
STORED = T.StructType([T.StructField("uid", T.LongType(), False), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
#: A document as it is sent: a business key, indexed fields with their tokens, and stored fields.
DOCUMENT = T.StructType(
    [
        T.StructField("object_id", T.IntegerType(), False),
        T.StructField("fields", T.ArrayType(FIELD, False)),
        T.StructField("timestamp", T.IntegerType()),
        T.StructField("segmentationHost", T.StringType()),
        T.StructField("shardIdx", T.IntegerType()),
        T.StructField("doc", STORED),
    ]
)
#: The position of a token that is sent without one.
NO_POSITION = 255
#: An entry of the key-value log. crc is over timestamp, lengths, key and value.
ENTRY = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("tstamp", T.IntegerType(), False),
        T.StructField("file_id", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("crc", T.LongType()),
    ]
)
