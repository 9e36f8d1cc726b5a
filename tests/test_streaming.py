from pathlib import Path

from conftest import FIRST, SECOND, column
from pyspark.sql import functions as F

from editwake.functions import predicates as p
from editwake.operators.batch import match_saved_queries
from editwake.operators.trends import trend
from editwake.schema import CLAUSE
from editwake.session import work_path
from editwake.sources.diff_files import parse_revisions
from editwake.sources.revision_table import read_revisions
from editwake.streaming import jobs


def drop(spark, folder, name, *lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{folder}/{name}")


def test_ingest_in_steps(spark):
    source, table, state, rejects = (
        work_path(spark, n) for n in ("in", "table", "state", "rejects")
    )

    def run():
        jobs.stream_ingest(
            spark, source, table, state, width=100, max_files=1, rejects=rejects
        ).awaitTermination()
        return {r.rev_id: r.namespace for r in read_revisions(spark, table).collect()}

    drop(spark, source, "a", FIRST, SECOND, "broken line")
    assert run() == {501: 3, 502: 0}
    assert run() == {501: 3, 502: 0}
    moved = FIRST.replace("\t3\t'Sandbox'", "\t1\t'Sandbox'")
    again = FIRST.replace("\t3\t'Sandbox'", "\t5\t'Sandbox'")
    drop(spark, source, "b", moved, again, SECOND.replace("502", "903"))
    assert run() == {501: 5, 502: 0, 903: 0}
    bad = spark.read.parquet(rejects).collect()
    assert [(r.value, r.reason) for r in bad] == [("broken line", "too few columns")]


def test_the_file_modified_last_wins_however_batches_are_cut(spark):
    for max_files in (None, 1):
        source, table, state = (work_path(spark, n) for n in ("in", "table", "state"))
        drop(spark, source, "z", FIRST)
        drop(spark, source, "a", FIRST.replace("\t3\t'Sandbox'", "\t5\t'Sandbox'"), "broken")
        jobs.stream_ingest(spark, source, table, state, max_files=max_files).awaitTermination()
        assert column(read_revisions(spark, table), "namespace") == [5]
        assert column(spark.read.parquet(f"{table}-rejects"), "value") == ["broken"]


def test_ingest_with_load_filter(spark):
    source, table, state = (work_path(spark, n) for n in ("in", "table", "state"))
    drop(spark, source, "a", FIRST, SECOND)
    jobs.stream_ingest(spark, source, table, state, keep=lambda df: p.talk_only(df.namespace)).awaitTermination()
    assert column(read_revisions(spark, table), "rev_id") == [501]


def edits(days):
    return [
        SECOND.replace("502", str(1000 + d)).replace("1014749333", str(1014749333 + d * 86400))
        for d in days
    ]


def test_running_trend_equals_batch(spark):
    source = work_path(spark, "in")
    # The newest days first, one file a time; copies count once.
    for k, days in enumerate([range(5, 40), range(2, 6), range(0, 3)]):
        drop(spark, source, f"f{k}", *edits(days))
    lines = spark.createDataFrame([(x,) for x in edits(range(40))], "value string")
    predicate = p.phrase("added", "world")
    for by in ("day", "month"):
        stream = jobs.stream_trend(
            jobs.read_revision_stream(spark, source, max_files=1), predicate, by
        )
        found = jobs.final_counts(spark, stream, work_path(spark, "out"))
        batch = trend(parse_revisions(lines).where(predicate), by)
        assert {r.period: r.hits for r in found.collect()} == {r.period: r.hits for r in batch.collect()}


def test_closed_days_are_appended(spark):
    source, out = work_path(spark, "in"), work_path(spark, "out")
    drop(spark, source, "a", *edits(range(0, 10)))
    lines = jobs.read_revision_stream(spark, source)
    stream = jobs.stream_trend(lines, F.lit(True), "day", lateness="1 day")
    jobs.append_to(stream, out).awaitTermination()
    closed = spark.read.parquet(out)
    # The last days stay open for late revisions.
    assert {r.period: r.hits for r in closed.collect()} == {f"2002-02-{26 + d}": 1 for d in range(3)} | {
        f"2002-03-0{d}": 1 for d in range(1, 6)
    }


def test_matching_new_revisions(spark):
    source, out = work_path(spark, "in"), work_path(spark, "out")
    rows = [(q, 0, "must", "added", "phrase", x, None, None) for q, x in ((1, "world"), (2, "Hello"))]
    saved = spark.createDataFrame(rows, CLAUSE)
    drop(spark, source, "a", FIRST)
    jobs.stream_match(jobs.read_revision_stream(spark, source), saved, out).awaitTermination()
    drop(spark, source, "b", SECOND)
    jobs.stream_match(jobs.read_revision_stream(spark, source), saved, out).awaitTermination()
    found = sorted((r.query_id, r.rev_id) for r in jobs.read_matches(spark, out).collect())
    lines = spark.createDataFrame([(FIRST,), (SECOND,)], "value string")
    batch = match_saved_queries(parse_revisions(lines), saved)
    assert found == sorted((r.query_id, r.rev_id) for r in batch.collect())


def test_a_trend_takes_back_what_is_replaced(spark):
    """A version that stops matching no longer counts; neither repeated batches nor older files change that."""
    source, table, out = (work_path(spark, n) for n in ("in", "table", "out"))

    def run():
        jobs.stream_table_trend(spark, source, table, out, p.phrase("added", "world"), "day", width=10).awaitTermination()
        return {r.period: r.hits for r in jobs.table_trend(spark, out).collect()}

    drop(spark, source, "a", FIRST, SECOND)
    assert run() == {"2002-02-25": 1, "2002-02-26": 1}
    drop(spark, source, "b", SECOND.replace("worldly", "other"))
    assert run() == {"2002-02-25": 1}
    # The same batch again, as after a failure between the table's change and the commit.
    for name in ("1", ".1.crc"):
        (Path(out.removeprefix("file:")) / "state" / "commits" / name).unlink(missing_ok=True)
    assert run() == {"2002-02-25": 1}
    drop(spark, source, "c", SECOND)
    assert run() == {"2002-02-25": 1, "2002-02-26": 1}


def test_input_files_are_bounded(spark, revisions):
    """One file while it is small; of more bytes several tasks write files, with the same lines."""
    from checks.matching import write_lines

    # Sixteen partitions, so that only the bytes say how many files there are.
    copies = revisions.crossJoin(spark.range(40)).drop("id").repartition(16)
    for most, files in ((2**29, 1), (500, 2)):
        path = work_path(spark, "lines")
        write_lines(copies, path, most)
        lines = spark.read.text(path).select("value", "_metadata.file_path")
        assert lines.count() == 80
        assert (lines.select("file_path").distinct().count() > 1) == (files > 1)


def test_lines_are_packed_and_a_packed_batch_is_read_in_parts(spark, revisions, tmp_path, monkeypatch):
    """One task reads a packed file; the batch is then written in row groups that tasks read apart."""
    from checks.matching import write_lines

    # Lines that differ, so that several row groups have bytes.
    copies = revisions.crossJoin(spark.range(20_000)).withColumn("title", F.sha2(F.col("id").cast("string"), 512)).drop("id")
    path = str(tmp_path / "lines")
    write_lines(copies, path)
    files = [f for f in Path(path).iterdir() if f.name.startswith("part-")]
    assert [f.suffix for f in files] == [".gz"]
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    monkeypatch.setattr(jobs, "ROW_GROUP", 2**18)
    monkeypatch.setattr(jobs, "work_path", lambda *_: str(tmp_path / "parts"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2**19))
    try:
        spread = jobs._spread(lines, str(tmp_path / "parts"))
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert lines.rdd.getNumPartitions() == 1 and len(sizes) > 1 and max(sizes) < 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert spread.exceptAll(lines).isEmpty() and lines.exceptAll(spread).isEmpty()
