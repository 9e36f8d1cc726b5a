"""The revision table: loading, appending, upserting, merging, looking up.

Stored tables are Parquet, partitioned by ``id_range`` (revision ids in steps
of ``ID_RANGE``) and ordered by time inside. A revision never changes its
range, so an upsert adds its rows to the ranges they fall into, writes anew what
stays of the ranges in which it replaces some, and leaves the rest of the table
alone. Ranges should be so wide that one holds some gigabytes.

Files are never overwritten. A manifest, one small file per state of the table,
names the folders of each range with their first and last time; ids grow with
time, so a time filter skips nearly all ranges, and inside them row groups by
their minima and maxima. Only the newest manifest is read, and small folders of a
range are merged as they get many, so the work of an append does not grow with the
number of those before. When a change begins, the folders that the newest manifest
does not name are removed, so the disk holds two states at most: what was read of
the state before the newest can be finished until then.
A table has one writer at a time: a manifest appears by the rename of its folder,
which two writers of one number could both try, and not all stores rename at once.
"""

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions.derive import added_text, removed_text
from editwake.functions.predicates import ts_range
from editwake.plans.layout import BROADCAST_IDS, drop_ids, fits, keep_ids, small_side, step
from editwake.schema import REVISION
from editwake.session import drop_folder, folder_names, shared_dir, shuffles_removed, work_path
from editwake.sources.diff_files import POSITION

ID_RANGE = 1_000_000
# A new table of more ranges than this gets wider ones: each range is a folder of its own.
MOST_RANGES = 512
MANIFEST = "id_range bigint, version string, first timestamp, last timestamp, n_rows bigint"
# Folders of a range that are of about one size are merged when there are so many.
MERGED = 8
# Rows that lie by range already are not shuffled if their files have so many of them or more.
FILE_ROWS = 1_000
# Texts take two thirds of what the usual codec needs.
CODEC = "zstd"


def id_range(rev_id: str | Column = "rev_id", width: int = ID_RANGE) -> Column:
    return step(rev_id, width)


def latest_revision(
    revisions: DataFrame, order: Sequence[str] = POSITION, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """One row per rev_id, the last in ``order``; the order columns go away.

    Ids that occur once, most of them, are told by a count of the bare ids. Of the
    others the last place is found on bare ids and places, and while these are few
    the rows are filtered where they are. Else, or where a place occurs twice, the
    rows of such ids are aggregated; their copies collapse before the shuffle.
    """
    shared_dir(revisions.sparkSession)
    rest = [c for c in revisions.columns if c != "rev_id" and c not in order]
    counted = revisions.groupBy("rev_id").agg(F.count("*").alias("n"))
    repeated = small_side(counted.where("n > 1").select("rev_id").checkpoint(), broadcast_ids)
    places = revisions.select("rev_id", *order).join(repeated, "rev_id", "left_semi")
    places = places.groupBy("rev_id", *order).agg(F.count("*").alias("_n"))
    ends = places.groupBy("rev_id").agg(F.max(F.struct(*order, "_n")).alias("_last")).checkpoint()
    texts = [F.octet_length(f"_last.{c}") for c in order if revisions.schema[c].dataType.typeName() == "string"]
    if fits(ends, broadcast_ids, sum(texts, F.lit(0))) and ends.where("_last._n > 1").isEmpty():
        is_last = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_last.{c}")) for c in order])
        placed = revisions.join(F.broadcast(ends), "rev_id", "left")
        return placed.where(F.col("_last").isNull() | is_last).select("rev_id", *rest)
    once = revisions.join(repeated, "rev_id", "left_anti").select("rev_id", *rest)
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    again = revisions.join(repeated, "rev_id", "left_semi").groupBy("rev_id").agg(last)
    return once.unionByName(again.select("rev_id", "last.*"))


def append_revisions(table: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of rows; copies of a revision are kept."""
    return table.unionByName(new)


def upsert_revisions(
    base: DataFrame,
    new: DataFrame,
    order: Sequence[str] = POSITION,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """``base`` without the revisions that ``new`` has again, and the last of those."""
    kept = missing_revisions(base, new, broadcast_ids)
    return kept.unionByName(latest_revision(new, order).select(*base.columns))


def missing_revisions(
    base: DataFrame, new: DataFrame, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """Rows of ``base`` whose rev_id does not occur in ``new``."""
    return drop_ids(base, new, rows=broadcast_ids)


def lookup_revisions(
    revisions: DataFrame, ids: DataFrame, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """The stored rows of the given ids."""
    return keep_ids(revisions, ids, rows=broadcast_ids)


def merge_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, copies included."""
    return reduce(DataFrame.unionByName, tables)


def table_stats(revisions: DataFrame) -> DataFrame:
    """Number of rows and of distinct revisions."""
    return (
        revisions.groupBy("rev_id")
        .agg(F.count("*").alias("copies"))
        .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("docs"), F.count("*").alias("revisions"))
    )


def _fitting(revisions: DataFrame, width: int) -> int:
    """``width``, or the multiple of it at which a new table has MOST_RANGES ranges at most.

    Counted on bare ids. Folders and files then follow the size of the table, however
    small the width that was asked for.
    """
    ranges = revisions.select(id_range(width=width).alias("id_range")).distinct()
    while (n := ranges.count()) > MOST_RANGES:
        width *= -(-n // MOST_RANGES)
        ranges = revisions.select(id_range(width=width).alias("id_range")).distinct()
    return width


def _gathered(ranged: DataFrame) -> bool:
    """Whether tasks read the ranges one after the other, as files in the order of ids have them.

    Told by a count of bare ids. Then each task can write its ranges as it is: at most
    one file more for each task, none of them small, and no text is shuffled.
    """
    held = ranged.select("id_range", F.spark_partition_id().alias("task")).groupBy("id_range", "task")
    held = held.agg(F.count("*").alias("rows"))
    counts = (F.count("*"), F.count_distinct("id_range"), F.count_distinct("task"), F.sum("rows"))
    pairs, ranges, tasks, rows = held.agg(*counts).first()
    return 0 < pairs <= ranges + tasks and rows >= FILE_ROWS * pairs


def _lean(revisions: DataFrame) -> DataFrame:
    """Without the texts that can be made of the hunks again, for a shuffle; ``_whole`` makes them."""
    made = F.col("added").eqNullSafe(added_text(F.col("hunks"))) & F.col("removed").eqNullSafe(removed_text(F.col("hunks")))
    marked = revisions.withColumn("_made", made)
    return marked.withColumns({c: F.when(~F.col("_made"), F.col(c)) for c in ("added", "removed")})


def _whole(lean: DataFrame) -> DataFrame:
    hunks = F.col("hunks")
    texts = {"added": added_text(hunks), "removed": removed_text(hunks)}
    return lean.withColumns({c: F.when(F.col("_made"), t).otherwise(F.col(c)) for c, t in texts.items()}).drop("_made")


def _write_version(revisions: DataFrame, path: str, width: int) -> list[tuple]:
    """Store revisions beside what there is, each id range in files ordered by time.

    Rows that are not in the order of ranges are rebalanced by range: adaptive
    execution splits a range with many bytes and unites small ones, so the number of
    writers and files follows the bytes and the ranges, and copies of an id do no harm;
    there is no sampling pass as for a range partitioning. Added and removed texts are
    made again after that, where the hunks tell them. Returns the manifest's rows.
    """
    # The width goes into the files, so that no reader has to be told.
    marked = revisions.withMetadata("rev_id", {"id_range": width})
    version = uuid.uuid4().hex
    folder = f"{path}/data/version={version}"
    with shuffles_removed(revisions.sparkSession):
        ranged = marked.withColumn("id_range", id_range(width=width))
        dealt = _lean(ranged) if _gathered(ranged) else _lean(ranged).hint("rebalance", "id_range")
        (
            _whole(dealt.sortWithinPartitions("id_range", "timestamp"))
            .write.option("compression", CODEC)
            .partitionBy("id_range")
            .parquet(folder)
        )
    stored = revisions.sparkSession.read.schema("timestamp timestamp, id_range bigint").parquet(folder)
    bounds = stored.groupBy("id_range").agg(F.min("timestamp"), F.max("timestamp"), F.count("*"))
    # One row per id range: bounded by the id space, not by the rows.
    rows = [(r[0], version, *r[1:]) for r in bounds.collect()]
    if not rows:
        drop_folder(revisions.sparkSession, folder)
    return rows


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the manifests there are, by the names of their folders alone."""
    names = folder_names(spark, folder)
    return sorted(int(n.removeprefix("number=")) for n in names if n.startswith("number="))


def _manifest(spark: SparkSession, path: str) -> tuple[int, list] | None:
    """The number and the rows of the newest manifest; None where there is no table."""
    numbers = _numbers(spark, f"{path}/manifest")
    if not numbers:
        return None
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/number={numbers[-1]}").collect()
    return numbers[-1], [tuple(r) for r in rows if r["version"]]


def _switch(spark: SparkSession, path: str, number: int, rows: list[tuple]) -> None:
    """Make these ranges the table: one small file appears at once, or not at all.

    The row without a version keeps the manifest of an empty table from being no table.
    """
    listed = spark.createDataFrame([(None, "", None, None, 0), *rows], MANIFEST)
    listed.coalesce(1).write.parquet(f"{path}/manifest/number={number}")


def _sweep(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Remove the folders that no row names: of earlier states, and of writers that were lost."""
    named: dict[str, set[str]] = {}
    for k, version, *_ in rows:
        named.setdefault(f"version={version}", set()).add(f"id_range={k}")
    for version in folder_names(spark, f"{path}/data"):
        folder = f"{path}/data/{version}"
        if version not in named:
            drop_folder(spark, folder)
            continue
        for name in folder_names(spark, folder):
            if name.startswith("id_range=") and name not in named[version]:
                drop_folder(spark, f"{folder}/{name}")


def remove_old_states(spark: SparkSession, path: str) -> None:
    """Remove the folders of all states of a table but the newest, which no reader may need then.

    A change does that when it begins; this is for tables that are not changed again soon.
    """
    found = _manifest(spark, path)
    if found is None:
        raise ValueError(f"there is no table in {path}")
    _sweep(spark, path, found[1])


def _merged(spark: SparkSession, path: str, rows: list[tuple], width: int, columns: Sequence[str]) -> list[tuple]:
    """The rows of a manifest after folders of a range that are many of about one size became one."""
    alike: dict[tuple, list[tuple]] = {}
    for row in rows:
        alike.setdefault((row[0], row[4].bit_length() // 2), []).append(row)
    many = [row for same in alike.values() if len(same) >= MERGED for row in same]
    if not many:
        return rows
    merged = _stored(spark, path, many).select(*columns)
    return [r for r in rows if r not in many] + _write_version(merged, path, width)


def write_revisions(revisions: DataFrame, path: str, width: int = ID_RANGE) -> None:
    """Store revisions as a new table, in ranges of ``width`` or, if these were very many, a multiple."""
    spark = revisions.sparkSession
    if _manifest(spark, path) is not None:
        raise ValueError(f"there is a table in {path}")
    _switch(spark, path, 1, _write_version(revisions, path, _fitting(revisions, width)))


def _stored(spark: SparkSession, path: str, rows: list[tuple]) -> DataFrame:
    """The revisions in the folders that rows of a manifest name."""
    folders = [f"{path}/data/version={version}/id_range={k}" for k, version, *_ in rows]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("version")


def read_revisions(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """A stored table as it is now, with ``id_range`` as an extra column.

    With time bounds as ``ts_range`` takes them, only the id ranges are read
    that hold revisions of that time, by the bounds in the manifest; rows
    outside the bounds remain in these, for the predicate to drop.
    """
    found = _manifest(spark, path)
    if found is None:
        raise ValueError(f"there is no table in {path}")
    number, rows = found
    if not rows:
        return spark.createDataFrame([], REVISION).withColumn("id_range", F.lit(0))
    # Which state this is goes with the column, so that searches can ask the manifest.
    table = _stored(spark, path, rows).withMetadata("id_range", {"table": path, "manifest": number})
    return in_time(table, start, end)


def is_stored(table: DataFrame) -> bool:
    """Whether the columns tell of which state of a stored table they are."""
    return "id_range" in table.columns and "manifest" in (table.schema["id_range"].metadata or {})


def in_time(table: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Of a stored table the id ranges that hold revisions of the time, by the bounds in its manifest.

    Bounds are those of ``ts_range``; rows outside remain for the predicate to
    drop. Any other DataFrame stays as it is.
    """
    if (start is None and end is None) or not is_stored(table):
        return table
    state = table.schema["id_range"].metadata
    spark = table.sparkSession
    listed = spark.read.schema(MANIFEST).parquet(f"{state['table']}/manifest/number={state['manifest']}")
    wanted = listed.where("version <> ''").where(ts_range(start, None, "last") & ts_range(None, end, "first"))
    # One number per id range: bounded by the id space, not by the rows.
    ranges = sorted(r[0] for r in wanted.select("id_range").distinct().collect())
    return table.where(F.col("id_range").isin(ranges))


def range_width(table: DataFrame) -> int | None:
    """Ids per range of a stored table; None for any other DataFrame."""
    if not {"rev_id", "id_range"} <= set(table.columns):
        return None
    return table.schema["rev_id"].metadata.get("id_range")


def _width_of(table: DataFrame) -> int:
    width = range_width(table)
    if width is None:
        raise ValueError("not a stored revision table: its files tell no range width")
    return width


def append_table(spark: SparkSession, new: DataFrame, path: str, width: int = ID_RANGE) -> None:
    """Add rows to a stored table, copies included. ``width`` is for a new table."""
    number, rows = _manifest(spark, path) or (0, [])
    _sweep(spark, path, rows)
    width = _width_of(read_revisions(spark, path)) if rows else _fitting(new, width)
    rows = rows + _write_version(new.select(*REVISION.names), path, width)
    _switch(spark, path, number + 1, _merged(spark, path, rows, width, REVISION.names))


@dataclass(frozen=True)
class Batch:
    """The last version of each revision of a batch, stored as id ranges that can become part of a table.

    ``rows`` names the ranges as a manifest does, ``ids`` has bare ids with their ranges
    and, if the order is kept, places, for what is asked several times.
    """

    root: str
    rows: list[tuple]
    whole: DataFrame
    ids: DataFrame
    folder: str


def _older(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """The ids of a batch that are stored with a later place."""
    places = stored.select("rev_id", F.col("loaded").alias("there"))
    return ids.join(places, "rev_id").where("there > loaded").select("rev_id", ids["id_range"])


def settle(
    new: DataFrame,
    root: str,
    order: Sequence[str] = POSITION,
    broadcast_ids: int = BROADCAST_IDS,
    width: int = ID_RANGE,
    keep_order: bool = True,
) -> Batch:
    """One row per revision of a batch, written once, beside the ranges of the table in ``root``.

    What is done with a batch reads it several times, mostly its ids. The files survive
    the loss of executors and fix the batch while a table is changed; an upsert makes
    them part of the table, so texts are not written again. ``unsettle`` removes the bare
    ids, and the next change of the table what did not become part of it. ``loaded`` is
    the place of a revision in ``order``.
    """
    spark = new.sparkSession
    found = _manifest(spark, root)
    _sweep(spark, root, found[1] if found else [])
    if keep_order:
        new = new.withColumn("loaded", F.struct(*order))
    names = [*REVISION.names, "loaded"] if keep_order else list(REVISION.names)
    last = latest_revision(new, order, broadcast_ids).select(*names)
    width = _width_of(read_revisions(spark, root)) if found and found[1] else _fitting(last, width)
    rows = _write_version(last, root, width)
    whole = _stored(spark, root, rows) if rows else spark.createDataFrame([], last.schema).withColumn("id_range", F.lit(0))
    folder = work_path(spark, "batch")
    places = whole.select("rev_id", "id_range", *names[len(REVISION.names) :])
    places.write.option("compression", CODEC).parquet(folder)
    return Batch(root, rows, whole, spark.read.schema(places.schema).parquet(folder), folder)


def unsettle(batch: Batch) -> None:
    """Remove the bare ids of a settled batch that is no longer read."""
    drop_folder(batch.whole.sparkSession, batch.folder)


def upsert_changes(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    order: Sequence[str] = POSITION,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """What an upsert with ``keep_order`` is going to change: revisions with ``change`` 1 or -1.

    A revision that the batch replaces leaves as it is stored and comes as it will
    be; older versions than the stored one change nothing. Ask before the upsert.
    """
    found = _manifest(spark, path)
    width = _width_of(read_revisions(spark, path)) if found and found[1] else ID_RANGE
    return changes_of(spark, settle(new, work_path(spark, "changes"), order, broadcast_ids, width), path, broadcast_ids)


def changes_of(spark: SparkSession, batch: Batch, path: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``upsert_changes`` of a settled batch."""
    whole = batch.whole.select(*REVISION.names)
    found = _manifest(spark, path)
    if found is None or not found[1]:
        return whole.withColumn("change", F.lit(1))
    stored = keep_ids(read_revisions(spark, path), batch.ids, rows=broadcast_ids)
    touched = id_range(width=_width_of(read_revisions(spark, path)))
    touched = [r[0] for r in batch.ids.select(touched).distinct().collect()]
    stored = stored.where(F.col("id_range").isin(touched))
    older = _older(batch.ids, stored)
    coming = drop_ids(whole, older, rows=broadcast_ids)
    leaving = drop_ids(stored, older, rows=broadcast_ids).select(*REVISION.names)
    return coming.withColumn("change", F.lit(1)).unionByName(leaving.withColumn("change", F.lit(-1)))


def upsert_table(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    order: Sequence[str] = POSITION,
    width: int = ID_RANGE,
    broadcast_ids: int = BROADCAST_IDS,
    keep_order: bool = False,
) -> None:
    """Upsert into a stored table, creating it with ranges of ``width`` if needed.

    Adds the new rows as files of their ranges, and writes anew what stays of the
    ranges in which they replace some, beside the old files; the table changes when
    its manifest does, so a writer that is lost in between leaves the table as it was.
    Repeating the call with the same batch changes nothing, so a replayed stream batch
    is harmless. With ``keep_order`` the table keeps the place of each revision in
    ``order`` as ``loaded``, and a stored revision gives way only to one not before it.
    """
    batch = settle(new, path, order, broadcast_ids, width, keep_order)
    try:
        upsert_settled(spark, batch, broadcast_ids, keep_order)
    finally:
        unsettle(batch)


def upsert_settled(
    spark: SparkSession, batch: Batch, broadcast_ids: int = BROADCAST_IDS, keep_order: bool = False
) -> None:
    """``upsert_table`` of a batch that was settled beside the table."""
    path = batch.root
    kept = [*REVISION.names, "loaded"] if keep_order else list(REVISION.names)
    number, rows = _manifest(spark, path) or (0, [])
    if not rows:
        _switch(spark, path, number + 1, batch.rows)
        return
    if not batch.rows:
        return
    table = read_revisions(spark, path)
    width = _width_of(table)
    if ("loaded" in table.columns) != keep_order:
        raise ValueError("the table was made with another choice of keep_order")

    def ranges(ids: DataFrame) -> list[int]:
        # One number per id range: bounded by the id space, not by the batch.
        return sorted(r[0] for r in ids.select("id_range").distinct().collect())

    stored = table.where(F.col("id_range").isin([r[0] for r in batch.rows])).select(*kept, "id_range")
    ids, coming = batch.ids, batch.rows
    if keep_order:
        older = _older(ids, stored)
        late = ranges(older)
        if late:
            ids = drop_ids(ids, older, rows=broadcast_ids)
            rest = drop_ids(batch.whole.where(F.col("id_range").isin(late)), older, rows=broadcast_ids)
            coming = [r for r in coming if r[0] not in late] + _write_version(rest.select(*kept), path, width)
    replaced = ranges(keep_ids(stored.select("rev_id", "id_range"), ids, rows=broadcast_ids))
    staying = missing_revisions(stored.where(F.col("id_range").isin(replaced)), ids, broadcast_ids)
    if replaced:
        rows = [r for r in rows if r[0] not in replaced] + _write_version(staying.select(*kept), path, width)
    _switch(spark, path, number + 1, _merged(spark, path, rows + coming, width, kept))
