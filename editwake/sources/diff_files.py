"""Diff files: one revision per line, tab separated, hunks after the header."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions import derive
from editwake.functions.text import escape, unescape, unquote
from editwake.schema import HEADER_FIELDS, REVISION

# Where a line stands: files in the order they were modified, then by path; a
# split of a file knows its offset, and ids increase inside a split, whichever
# task reads it.
POSITION = ("modified", "file", "block", "line")


def split_position() -> list[Column]:
    """The file and split a line is read from; only right above the scan."""
    return [
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ]


def read_diff_lines(spark: SparkSession, path) -> DataFrame:
    """All lines below a directory (or several), with their POSITION."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select("value", *split_position(), F.monotonically_increasing_id().alias("line"))


def _with_cells(lines: DataFrame) -> DataFrame:
    """Lines with their tab-separated cells.

    Generated rather than projected: a filter on a projected array would be
    pushed below it and split the line again for every cell it looks at.
    """
    cells = F.array(F.split("value", "\t", -1))
    return lines.select("*", F.explode(cells).alias("cells"))


def _whole(cell: Column) -> Column:
    """A header cell that is not empty and not a quote cut short."""
    return cell.isNotNull() & ~cell.isin("", "u", "'", "u'")


def _header(cells: Column) -> dict[str, Column]:
    """The header columns; a value that does not fit its type is null."""
    text = {name: unquote(F.get(cells, F.lit(i))) for i, name in enumerate(HEADER_FIELDS)}
    epoch = F.get(cells, F.lit(4)).try_cast("bigint")
    return {
        **text,
        "rev_id": text["rev_id"].try_cast("bigint"),
        "page_id": text["page_id"].try_cast("bigint"),
        "namespace": text["namespace"].try_cast("int"),
        "timestamp": F.timestamp_seconds(epoch),
        "minor": F.when(text["minor"] == "True", True).when(text["minor"] == "False", False),
        "user_id": F.when(text["user_id"] != "None", text["user_id"].try_cast("bigint")),
    }


def _parsable(cells: Column) -> Column:
    """Nine whole header cells of the right types."""
    header = _header(cells)
    tests = [_whole(F.get(cells, F.lit(i))) for i in range(len(HEADER_FIELDS))]
    tests += [header[n].isNotNull() for n in ("rev_id", "page_id", "namespace", "timestamp", "minor")]
    # An absent user is spelled out; anything else must be a number.
    user = unquote(F.get(cells, F.lit(7)))
    tests.append((user == "None") | header["user_id"].isNotNull())
    parsable = reduce(and_, tests, F.size(cells) >= len(HEADER_FIELDS))
    return F.coalesce(parsable, F.lit(False))


def parse_hunks(cells: Column, readable: bool = True) -> Column:
    """``position:sign:literal`` cells as structs; unreadable ones are skipped.

    A literal of at most two characters is an empty text. Position and sign
    stay texts, since they are searchable as written. The steps are separate
    transforms so that each value is computed once. With ``readable=False``
    the result is the cells that are skipped.
    """
    parts = F.transform(
        cells, lambda c: F.struct(c.alias("cell"), F.split(c, ":", 3).alias("parts"))
    )
    bare = F.transform(
        parts,
        lambda h: F.struct(
            h.cell.alias("cell"),
            F.get(h.parts, F.lit(0)).alias("pos"),
            F.get(h.parts, F.lit(1)).alias("sign"),
            _literal(F.get(h.parts, F.lit(2))).alias("literal"),
        ),
    )
    hunks = F.transform(
        bare,
        lambda h: F.struct(
            h.pos.alias("pos"),
            h.sign.alias("sign"),
            unescape(h.literal).alias("text"),
            F.when(F.lit(not readable), h.cell).alias("cell"),
        ),
    )
    if not readable:
        return F.transform(F.filter(hunks, lambda h: h.text.isNull()), lambda h: h.cell)
    return F.transform(
        F.filter(hunks, lambda h: h.text.isNotNull()),
        lambda h: F.struct(h.pos.alias("pos"), h.sign.alias("sign"), h.text.alias("text")),
    )


def _literal(rest: Column) -> Column:
    return F.when(F.length(rest) <= 2, "").otherwise(unquote(rest))


def _hunk_cells(cells: Column) -> Column:
    """What follows the header, without the empty cells at the end of a line."""
    tail = F.slice(cells, len(HEADER_FIELDS) + 1, F.greatest(F.size(cells), F.lit(1)))
    return F.filter(tail, lambda c: c != "")


def parse_revisions(lines: DataFrame, keep=None) -> DataFrame:
    """Lines as revisions with all derived columns.

    ``keep`` maps the parsed DataFrame to a predicate, such as
    ``lambda df: talk_only(df.namespace)``. Extra columns of ``lines`` pass
    through, so file and line stay available for ordering.
    """
    extra = [c for c in lines.columns if c != "value"]
    cells = F.col("cells")
    parsed = (
        _with_cells(lines)
        .where(_parsable(cells))
        .select(
            *[c.alias(n) for n, c in _header(cells).items()],
            parse_hunks(_hunk_cells(cells)).cast(REVISION["hunks"].dataType).alias("hunks"),
            *extra,
        )
    )
    revisions = derive.with_derived(parsed).select(*REVISION.names, *extra)
    return revisions.where(keep(revisions)) if keep is not None else revisions


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """The lines ``parse_revisions`` leaves out, with the reason."""
    cells = F.col("cells")
    whole = reduce(
        and_, [_whole(F.get(cells, F.lit(i))) for i in range(len(HEADER_FIELDS))]
    )
    reason = (
        F.when(F.size(cells) < len(HEADER_FIELDS), "too few columns")
        .when(~whole, "empty column")
        .otherwise("wrong type")
    )
    return _with_cells(lines).where(~_parsable(cells)).select(*lines.columns, reason.alias("reason"))


def skipped_hunks(lines: DataFrame) -> DataFrame:
    """The hunk cells that cannot be read, one row each."""
    cells = F.col("cells")
    return (
        _with_cells(lines)
        .where(_parsable(cells))
        .select(
            F.get(cells, F.lit(0)).try_cast("bigint").alias("rev_id"),
            F.explode(parse_hunks(_hunk_cells(cells), readable=False)).alias("hunk"),
        )
    )


def format_diff_lines(revisions: DataFrame) -> DataFrame:
    """Revisions back as lines of a diff file, column ``value``."""

    def quoted(s: Column) -> Column:
        return F.concat(F.lit("u'"), s, F.lit("'"))

    header = [
        F.col("rev_id").cast("string"),
        F.col("page_id").cast("string"),
        F.col("namespace").cast("string"),
        quoted(F.col("title")),
        F.unix_timestamp("timestamp").cast("string"),
        quoted(F.col("comment")),
        F.when(F.col("minor"), "True").otherwise("False"),
        F.coalesce(F.col("user_id").cast("string"), F.lit("None")),
        quoted(F.col("user_text")),
    ]
    hunks = F.transform(
        "hunks", lambda h: F.concat_ws(":", h.pos, h.sign, quoted(escape(h.text)))
    )
    return revisions.select(
        F.array_join(F.concat(F.array(*header), hunks), "\t").alias("value")
    )
