"""Row types of the engine and the roles of their fields."""

from pyspark.sql import types as T

# The fields of a revision, in file order, then the derived ones.
HEADER_FIELDS = (
    "rev_id",
    "page_id",
    "namespace",
    "title",
    "timestamp",
    "comment",
    "minor",
    "user_id",
    "user_text",
)
DERIVED_FIELDS = ("added", "removed", "added_size", "removed_size", "action")

# Searched by substring; every other field is compared as a whole value.
# The most searched come first.
TEXT_FIELDS = ("added", "removed", "comment", "title", "user_text")

# Header texts keep their escapes in the table and lose them on output.
ESCAPED_FIELDS = ("title", "comment", "user_text")

HUNK = T.StructType(
    [
        T.StructField("pos", T.StringType()),
        T.StructField("sign", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

REVISION = T.StructType(
    [
        T.StructField("rev_id", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("namespace", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("comment", T.StringType()),
        T.StructField("minor", T.BooleanType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_text", T.StringType()),
        T.StructField("hunks", T.ArrayType(HUNK)),
        T.StructField("added", T.StringType()),
        T.StructField("removed", T.StringType()),
        T.StructField("added_size", T.IntegerType()),
        T.StructField("removed_size", T.IntegerType()),
        T.StructField("action", T.StringType()),
    ]
)

CLAUSE = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("clause_no", T.IntegerType()),
        T.StructField("occur", T.StringType()),  # must | should | must_not
        T.StructField("field", T.StringType()),
        T.StructField("kind", T.StringType()),  # phrase | term | wildcard | range
        T.StructField("value", T.StringType()),
        T.StructField("lo", T.StringType()),
        T.StructField("hi", T.StringType()),
    ]
)
