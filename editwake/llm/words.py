"""Words as Column code: runs of characters other than ASCII white space."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
GAPS = "[ \\t-\\r]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    bare = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(bare, F.lit("")) == "", none).otherwise(F.split(bare, GAPS))


def word_count(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.size(words_of(text)).cast("long")
