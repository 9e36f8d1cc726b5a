"""Derived columns of a revision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PERIOD_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
PERIOD_PATTERNS = {"day": r"\d{4}-\d{2}-\d{2}", "month": r"\d{4}-\d{2}"}


def _joined(hunks: Column, keep) -> Column:
    return F.array_join(
        F.transform(F.filter(hunks, keep), lambda h: F.concat(h.pos, h.sign, h.text, F.lit("\t"))),
        "",
    )


def added_text(hunks: Column) -> Column:
    """Position, sign and text of every hunk that is not a removal, tab ended."""
    return _joined(hunks, lambda h: h.sign != "-1")


def removed_text(hunks: Column) -> Column:
    """Position, sign and text of every removal, tab ended."""
    return _joined(hunks, lambda h: h.sign == "-1")


def text_size(text: Column) -> Column:
    """Length in code points, position prefixes and tabs included."""
    return F.length(text)


def action(added: Column, removed: Column) -> Column:
    """``both``, ``addition`` or ``removal``; without any hunk, ``removal``."""
    return (
        F.when((added != "") & (removed != ""), "both")
        .when(added != "", "addition")
        .otherwise("removal")
    )


def iso_timestamp(ts: Column) -> Column:
    """A timestamp as ISO text in UTC (the session time zone must be UTC)."""
    return F.date_format(ts, ISO_FORMAT)


def iso_from_epoch(epoch: Column) -> Column:
    """Epoch seconds as ISO text in UTC."""
    return iso_timestamp(F.timestamp_seconds(epoch.cast("bigint")))


def period_key(ts: Column, by: str = "month") -> Column:
    """The day or month of a timestamp as text; ``none`` where there is none."""
    return F.coalesce(F.date_format(ts, PERIOD_FORMATS[by]), F.lit("none"))


def period_key_of_text(text: Column, by: str = "month") -> Column:
    """The first day or month written in a text; ``none`` when there is none."""
    key = F.regexp_extract(text, PERIOD_PATTERNS[by], 0)
    return F.when(key == "", "none").otherwise(F.coalesce(key, F.lit("none")))


def normalise_date(key: Column) -> Column:
    """A period key in slashes; a month stands for its 15th."""
    slashed = F.replace(key, F.lit("-"), F.lit("/"))
    return F.when(
        F.size(F.split(slashed, "/")) == 2, F.concat(slashed, F.lit("/15"))
    ).otherwise(slashed)


def hyperlink(rev_id: Column) -> Column:
    """A spreadsheet formula that links a revision id to its diff page."""
    # Fixed value: the address of the diff page.
    return F.format_string(
        '=HYPERLINK("http://enwp.org/?diff=%s","%s")', rev_id.cast("string"), rev_id.cast("string")
    )


def with_derived(revisions):
    """Add the texts, sizes and action that follow from ``hunks``."""
    return (
        revisions.withColumns(
            {"added": added_text(F.col("hunks")), "removed": removed_text(F.col("hunks"))}
        )
        .withColumns(
            {
                "added_size": text_size(F.col("added")),
                "removed_size": text_size(F.col("removed")),
                "action": action(F.col("added"), F.col("removed")),
            }
        )
    )
