import time
from pathlib import Path

import pytest
from conftest import FIRST, SECOND, column
from pyspark.sql import functions as F

from editwake.functions import predicates as p
from editwake.functions.text import escape, unescape
from editwake.operators.hits import select_fields
from editwake.session import work_path
from editwake.sources import diff_files, query_files, revision_table, trend_files

POSITION = "value string, modified timestamp, file string, block long, line long"


def parse(spark, *rows):
    return diff_files.parse_revisions(spark.createDataFrame(list(rows), POSITION))


def test_fields_of_a_line(revisions):
    row = revisions.where("rev_id = 501").first()
    assert (row.page_id, row.namespace, row.title, row.minor) == (7, 3, "Sandbox", True)
    assert (row.comment, row.user_id, row.user_text) == ("tidy up", None, "Editor One")
    assert row.added == "121Hello\nworld [[a\t"
    assert row.removed == "30-1bye\t"
    assert (row.added_size, row.removed_size, row.action) == (19, 8, "both")
    assert [tuple(h) for h in row.hunks] == [("12", "1", "Hello\nworld [[a"), ("30", "-1", "bye")]


def test_header_texts_are_unescaped_on_output_only(revisions):
    other = revisions.where("rev_id = 502")
    assert other.first().comment == "na\\u00efve"
    assert select_fields(other, ["comment"]).first().comment == "naïve"


def test_actions(spark):
    head = "\t1\t0\t'T'\t0\tu'c'\tFalse\t1\tu'U'"
    rows = {
        1: "",
        2: "\t0:1:u'plus'",
        3: "\t0:-1:u'minus'",
        4: "\t0:1:u'plus'\t5:-1:u'minus'",
    }
    found = parse(spark, *[(f"{i}{head}{tail}", None, "f", 0, i) for i, tail in rows.items()])
    actions = {r.rev_id: r.action for r in found.collect()}
    assert actions == {1: "removal", 2: "addition", 3: "removal", 4: "both"}


def test_hunk_shapes(spark):
    cells = ["0:1:u'a:b'", "0:1:u'", "3:1:", "no colon", "4:only one", "7:0:'plain'", "8:1:u\"x\"", "9:1:u'\\u12'", ":1:u'abc'"]
    hunks = spark.createDataFrame([(cells,)], "cells array<string>").select(
        diff_files.parse_hunks(F.col("cells")).alias("good"),
        diff_files.parse_hunks(F.col("cells"), readable=False).alias("bad"),
    ).first()
    assert [tuple(h) for h in hunks.good] == [
        ("0", "1", "a:b"),
        ("0", "1", ""),
        ("3", "1", ""),
        ("7", "0", "plain"),
        ("8", "1", 'u"x"'),
        ("", "1", "abc"),
    ]
    assert hunks.bad == ["no colon", "4:only one", "9:1:u'\\u12'"]


def test_corrupt_lines_do_not_stop_a_file(spark):
    cells = SECOND.split("\t")
    rows = {
        "\t".join(cells[:3]): "too few columns",
        SECOND.replace("1014749333", "noon"): "wrong type",
        SECOND.replace("u'Other page'", ""): "empty column",
        SECOND.replace("u'Other page'", "u'"): "empty column",
        SECOND.replace("\t42\t", "\tforty\t"): "wrong type",
        SECOND.replace("False", "no"): "wrong type",
        "": "too few columns",
        FIRST: None,
    }
    lines = spark.createDataFrame([(r, None, "f", 0, i) for i, r in enumerate(rows)], POSITION)
    bad = {r.value: r.reason for r in diff_files.corrupt_lines(lines).collect()}
    assert bad == {r: reason for r, reason in rows.items() if reason}
    assert column(diff_files.parse_revisions(lines), "rev_id") == [501]


def test_unescape(spark):
    cases = {
        "plain": "plain",
        "a\\nb\\tc\\rd\\be\\ff": "a\nb\tc\rd\be\ff",
        "\\\\n \\' \\\"": "\\n ' \"",
        "\\u00e9\\uu00e9 \\u+00e9": "éé é",
        "\\ud83d\\ude00": "😀",
        "\\xE9 \\q": "xE9 q",
        "\\101\\60\\400\\8": "A0 08",
        "end\\": "end",
        "\\\\u12": "\\u12",
        "\\u12": None,
        "": "",
    }
    data = spark.createDataFrame(list(enumerate(cases)), "i int, s string")
    found = {r.s: r.t for r in data.select("s", unescape(F.col("s")).alias("t")).collect()}
    assert found == cases


def test_escape_is_undone(spark):
    texts = ["it's\n\ta \\ \r\"b\"", "\\n", "", "é😀"]
    data = spark.createDataFrame([(t,) for t in texts], "s string")
    assert column(data.select(unescape(escape(F.col("s"))))) == sorted(texts)


def test_round_trip(spark, revisions):
    again = diff_files.parse_revisions(diff_files.format_diff_lines(revisions))
    plain = revisions.drop(*diff_files.POSITION)
    assert sorted(map(str, again.collect())) == sorted(map(str, plain.collect()))


def test_files_in_nested_folders(spark, lines):
    path = work_path(spark, "nested")
    lines.where(F.col("line") == 0).select("value").write.text(f"{path}/a")
    lines.where(F.col("line") == 1).select("value").write.text(f"{path}/b/c")
    read = diff_files.read_diff_lines(spark, path)
    assert column(diff_files.parse_revisions(read), "rev_id") == [501, 502]
    assert set(diff_files.POSITION) <= set(read.columns)


def later(lines):
    """The first revision again, in a later file, with another namespace."""
    again = lines.where("line = 0").withColumns(
        {"value": F.replace("value", F.lit("\t3\t'Sandbox'"), F.lit("\t1\t'Sandbox'")), "file": F.lit("g")}
    )
    return diff_files.parse_revisions(again)


def test_upsert_keeps_the_later_version(lines, revisions):
    both = revisions.unionByName(later(lines))
    latest = revision_table.latest_revision(both)
    assert {r.rev_id: r.namespace for r in latest.collect()} == {501: 1, 502: 0}
    base = revisions.drop(*diff_files.POSITION)
    upserted = revision_table.upsert_revisions(base, later(lines))
    assert {r.rev_id: r.namespace for r in upserted.collect()} == {501: 1, 502: 0}
    shuffled = revision_table.upsert_revisions(base, later(lines), broadcast_ids=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, upserted.collect()))


def test_append_keeps_copies(lines, revisions):
    appended = revision_table.append_revisions(revisions, later(lines))
    stats = revision_table.table_stats(appended).first()
    assert (stats.docs, stats.revisions) == (3, 2)


def test_load_filters(lines):
    def load(keep):
        return column(diff_files.parse_revisions(lines, keep), "rev_id")

    assert load(lambda df: p.pass_all()) == [501, 502]
    assert load(lambda df: p.talk_only(df.namespace)) == [501]
    assert load(lambda df: p.user_talk_only(df.namespace)) == [501]


def test_talk_filter_and_negative_namespaces(spark):
    data = spark.createDataFrame([(i,) for i in range(-3, 6)], "namespace int")
    assert column(data.where(p.talk_only())) == [1, 3, 5]


def test_stored_table(spark, lines, revisions):
    path = work_path(spark, "stored")
    revision_table.upsert_table(spark, revisions, path, width=10)
    for _ in range(2):
        revision_table.upsert_table(spark, later(lines), path)
        stored = revision_table.read_revisions(spark, path)
        assert {r.rev_id: r.namespace for r in stored.collect()} == {501: 1, 502: 0}
    revision_table.append_table(spark, revisions, path)
    stored = revision_table.read_revisions(spark, path)
    assert column(stored, "rev_id") == [501, 501, 502, 502]


def test_upsert_leaves_other_ranges_alone(spark, revisions):
    path = work_path(spark, "ranges")
    base = revisions.withColumn("rev_id", F.col("rev_id") * 100)
    revision_table.upsert_table(spark, base, path, width=10)
    files = "_metadata.file_path"
    before = set(column(revision_table.read_revisions(spark, path).where("rev_id = 50200").select(files)))
    revision_table.upsert_table(spark, base.where("rev_id = 50100"), path)
    after = set(column(revision_table.read_revisions(spark, path).where("rev_id = 50200").select(files)))
    assert before == after


def test_a_lost_writer_leaves_the_table_as_it_was(spark, lines, revisions, monkeypatch):
    path = work_path(spark, "lost")
    revision_table.upsert_table(spark, revisions, path, width=10)
    switch = revision_table._switch

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(revision_table, "_switch", lost)
    for change in (revision_table.upsert_table, revision_table.append_table):
        with pytest.raises(KeyboardInterrupt):
            change(spark, later(lines), path)
        stored = revision_table.read_revisions(spark, path)
        assert {r.rev_id: r.namespace for r in stored.collect()} == {501: 3, 502: 0}
    monkeypatch.setattr(revision_table, "_switch", switch)
    revision_table.upsert_table(spark, later(lines), path)
    assert column(revision_table.read_revisions(spark, path), "namespace") == [0, 1]
    with pytest.raises(ValueError):
        revision_table.write_revisions(revisions, path)
    with pytest.raises(ValueError):
        revision_table.read_revisions(spark, path + "-none")


def test_time_bounds_choose_ranges(spark, revisions):
    path = work_path(spark, "times")
    base = revisions.withColumn("rev_id", F.col("rev_id") * 100)
    revision_table.upsert_table(spark, base, path, width=10)
    for bounds, ids in (
        ((None, None), [50100, 50200]), (("2002-02-26", None), [50200]), ((None, "2002-02-26"), [50100]),
        (("2003", None), []), (("2002", "2003"), [50100, 50200]),
    ):
        assert column(revision_table.read_revisions(spark, path, *bounds), "rev_id") == ids
    empty = work_path(spark, "empty")
    revision_table.upsert_table(spark, base.limit(0), empty)
    assert revision_table.read_revisions(spark, empty).collect() == []


def test_query_file(spark):
    path = work_path(spark, "queries")
    text = "\n".join(["hello", '"a:b!<c>",named.csv', '"say ""x"" now"', '"two\nlines"'] + ["q" * 200] * 8)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    rows = query_files.read_query_file(spark, path).orderBy("ordinal").collect()
    assert [r.query for r in rows[:4]] == ["hello", "a:b!<c>", 'say "x" now', "two\nlines"]
    assert [r.output for r in rows[:3]] == ["01_hello.csv", "named.csv", '03_say "x" now.csv']
    assert rows[4].output == "05_" + "q" * 97
    assert len(rows) == 12


def test_query_names_are_cleaned(spark):
    data = spark.createDataFrame([(1, "title:a!<b>", None)], "ordinal int, query string, output string")
    assert query_files.name_queries(data).first().output == "1_title__a____b__.csv"


def test_requests(spark):
    lines = [
        '{"q": "x"}',
        '{"q": "x", "fields": "rev_id", "max_revs": "7", "collapse_hits": "day"}',
        '{"q": "x", "fields": ["rev_id", "title"], "max_revs": 9}',
        '{"q": "x", "fields": ""}',
        '{"fields": []}',
        "not json",
    ]
    data = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    rows = query_files.parse_requests(data).orderBy("i").collect()
    assert [r.fields for r in rows[:5]] == [[], ["rev_id"], ["rev_id", "title"], [], []]
    assert [r.max_revs for r in rows[:3]] == [1000, 7, 9]
    assert [r.collapse_hits for r in rows[:2]] == ["no", "day"]
    assert (rows[0].version, rows[0].format) == ("0.1", "json")
    assert [r.valid for r in rows] == [True] * 4 + [False] * 2


def test_trend_files(spark):
    path = work_path(spark, "results")
    text = "# query\n2006-01,2,7;8\n2006-02,0\n2006-03#x,1,9\n2006-04,1,\"=HYPERLINK(\"\"u\"\",\"\"v\"\")\"\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    rows = trend_files.read_trend_csv(spark, path, "s").orderBy("date").collect()
    assert [(r.series, r.date, r.hits, r.ids) for r in rows] == [
        ("s", "2006-01", 2, "7;8"),
        ("s", "2006-04", 1, '=HYPERLINK("u","v")'),
    ]
    ids = spark.createDataFrame([("1;22;1;" + "9" * 30,)], "ids string")
    assert column(trend_files.extract_rev_ids(ids)) == ["1", "1", "22"]


def test_many_appends_merge_their_folders(spark, revisions, tmp_path):
    """The work of an append does not grow with those before: folders merge, one manifest is read."""
    path = str(tmp_path / "table")
    copies = []
    for n in range(20):
        revision_table.append_table(spark, revisions, path, width=1_000)
        copies.append(len(revision_table._manifest(spark, path)[1]))
    assert max(copies) <= 2 * revision_table.MERGED
    assert revision_table.read_revisions(spark, path).count() == 20 * revisions.count()
    assert revision_table._manifest(spark, path)[0] == 20


def test_changes_are_those_of_the_upsert(spark, revisions, tmp_path):
    path = str(tmp_path / "table")
    names = ["modified", "line"]

    def batch(df, when):
        return df.withColumns({"modified": F.timestamp_seconds(F.lit(when)), "line": F.lit(0)})

    first = batch(revisions, 100)
    found = revision_table.upsert_changes(spark, first, path, names)
    assert sorted(r.change for r in found.collect()) == [1] * revisions.count()
    revision_table.upsert_table(spark, first, path, names, width=10, keep_order=True)
    newer = batch(revisions.where("rev_id = 501").withColumn("added", F.lit("new")), 200)
    older = batch(revisions.where("rev_id = 502").withColumn("added", F.lit("old")), 50)
    changes = revision_table.upsert_changes(spark, newer.unionByName(older), path, names).collect()
    before = {r.rev_id: r.added for r in revisions.collect()}
    assert sorted((r.rev_id, r.change, r.added) for r in changes) == sorted([(501, 1, "new"), (501, -1, before[501])])


def many_revisions(spark, revisions, n=400):
    ids = spark.range(n).withColumnRenamed("id", "n")
    return revisions.where("rev_id = 501").crossJoin(ids).withColumn("rev_id", F.col("n") * 7).drop("n")


def test_small_widths_do_not_make_a_file_for_each_id(spark, revisions, tmp_path, monkeypatch):
    """Folders are bounded for a new table, and a range is one file while it is small."""
    monkeypatch.setattr(revision_table, "MOST_RANGES", 20)
    path = str(tmp_path / "table")
    many = many_revisions(spark, revisions)
    revision_table.write_revisions(many, path, width=10)
    table = revision_table.read_revisions(spark, path)
    ranges = table.select("id_range", F.col("_metadata.file_path").alias("file")).distinct().collect()
    assert 5 <= len(ranges) <= 20
    assert len({r["id_range"] for r in ranges}) == len(ranges)
    assert revision_table.range_width(table) % 10 == 0
    assert column(table, "rev_id") == column(many, "rev_id")


def test_the_last_version_is_found_by_places_or_by_rows(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", 1), (3, "d", None), (3, "e", 0), (None, "f", 1), (None, "g", 2)]
    data = spark.createDataFrame(rows, "rev_id long, title string, seq int")
    for small in (100, 0):
        last = revision_table.latest_revision(data, ["seq"], broadcast_ids=small)
        assert {"b", "c", "e"} <= set(column(last, "title")) and 1 == column(last, "title").count("b")
        assert not {"a", "d"} & set(column(last, "title"))
    tied = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1)], data.schema)
    assert column(revision_table.latest_revision(tied, ["seq"]), "rev_id") == [1, 2]


def test_an_upsert_leaves_no_batch_behind(spark, revisions, tmp_path, monkeypatch):
    folders = []
    fresh = revision_table.work_path
    monkeypatch.setattr(revision_table, "work_path", lambda *a: folders.append(fresh(*a)) or folders[-1])
    revision_table.upsert_table(spark, revisions.withColumn("seq", F.lit(1)), str(tmp_path / "t"), ["seq"])
    assert folders and not [f for f in folders if revision_table.folder_names(spark, f)]
    assert revision_table.read_revisions(spark, str(tmp_path / "t")).count() == revisions.count()


def versions_on_disk(spark, path):
    return {v.removeprefix("version=") for v in revision_table.folder_names(spark, f"{path}/data")}


def test_the_disk_holds_two_states_at_most(spark, revisions, tmp_path):
    """What the newest manifest does not name goes when a change begins, as do a lost writer's files."""
    path = str(tmp_path / "table")
    states, plain = [], revisions.drop(*diff_files.POSITION)
    for n in range(4):
        new = plain.withColumns({"namespace": F.lit(n), "seq": F.lit(n)})
        revision_table.upsert_table(spark, new, path, ["seq"], width=10)
        states.append({r[1] for r in revision_table._manifest(spark, path)[1]})
        assert states[-1] <= versions_on_disk(spark, path) <= set().union(*states[-2:])
        assert set(column(revision_table.read_revisions(spark, path), "namespace")) == {n}
    before = revision_table.read_revisions(spark, path)
    revision_table.append_table(spark, plain, path)
    assert set(column(before, "namespace")) == {3}
    revision_table.remove_old_states(spark, path)
    rows = revision_table._manifest(spark, path)[1]
    assert versions_on_disk(spark, path) == {r[1] for r in rows}
    assert revision_table.read_revisions(spark, path).count() == 2 * plain.count()
    with pytest.raises(ValueError):
        revision_table.remove_old_states(spark, path + "-none")


def test_a_batch_becomes_part_of_the_table(spark, revisions, tmp_path):
    """Ranges in which nothing is replaced keep their files, and those of the batch are not written again."""
    path = str(tmp_path / "table")
    plain = many_revisions(spark, revisions, 100).drop(*diff_files.POSITION)
    revision_table.upsert_table(spark, plain.withColumn("seq", F.lit(1)), path, ["seq"], width=70)
    first = {r[0]: r[1] for r in revision_table._manifest(spark, path)[1]}
    # The revision 7 again, and a new one in another range.
    again = plain.where("rev_id IN (7, 350)").withColumns(
        {"rev_id": F.when(F.col("rev_id") == 350, 351).otherwise(7), "title": F.lit("again"), "seq": F.lit(2)}
    )
    batch = revision_table.settle(again, path, ["seq"], keep_order=False)
    revision_table.upsert_settled(spark, batch)
    revision_table.unsettle(batch)
    rows = revision_table._manifest(spark, path)[1]
    assert set(batch.rows) <= set(rows)
    assert {k for k, v in first.items() if (k, v) not in {r[:2] for r in rows}} == {0}
    table = revision_table.read_revisions(spark, path)
    assert sorted(column(table, "rev_id")) == sorted([n * 7 for n in range(100)] + [351])
    assert column(table.where("title = 'again'"), "rev_id") == [7, 351]


def test_older_versions_of_a_batch_stay_out(spark, revisions, tmp_path):
    path = str(tmp_path / "table")
    plain = revisions.drop(*diff_files.POSITION)

    def upsert(namespace, seq):
        new = plain.withColumns({"namespace": F.lit(namespace), "seq": F.expr(seq)})
        revision_table.upsert_table(spark, new, path, ["seq"], width=1_000, keep_order=True)
        return {r.rev_id: r.namespace for r in revision_table.read_revisions(spark, path).collect()}

    assert upsert(1, "5") == {501: 1, 502: 1}
    assert upsert(2, "if(rev_id = 501, 4, 6)") == {501: 1, 502: 2}
    assert upsert(3, "3") == {501: 1, 502: 2}


def test_texts_that_hunks_tell_are_not_shuffled(spark, revisions, tmp_path):
    plain = revisions.drop(*diff_files.POSITION)
    other = plain.withColumns({"rev_id": F.col("rev_id") + 100, "added": F.lit("of its own"), "removed": F.lit(None).cast("string")})
    both = plain.unionByName(other)
    lean = revision_table._lean(both)
    assert column(lean.where("added IS NOT NULL"), "rev_id") == [601, 602]
    assert sorted(map(str, revision_table._whole(lean).collect())) == sorted(map(str, both.collect()))
    path = str(tmp_path / "table")
    revision_table.write_revisions(both, path, width=10)
    stored = revision_table.read_revisions(spark, path).select(*both.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, both.collect()))


def shuffled_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [Path(f) for f in files.mkString("\n").split("\n") if "/shuffle_" in f and f.endswith(".data")]
    return {f: f.stat().st_size for f in paths if f.exists()}


def test_writes_leave_no_shuffled_texts_behind(spark, revisions, tmp_path):
    from editwake.operators.postings import build_postings, write_postings

    # In no order of ids, so that rows are shuffled; texts that do not compress.
    text = F.sha2(F.col("rev_id").cast("string"), 512)
    many = many_revisions(spark, revisions).withColumns({"title": text, "added": text}).repartition(8)
    assert not revision_table._gathered(many.withColumn("id_range", revision_table.id_range(width=500)))
    for write in (
        lambda: revision_table._write_version(many, str(tmp_path / "table"), 500),
        lambda: write_postings(build_postings(many), str(tmp_path / "postings")),
    ):
        before = set(shuffled_bytes(spark))
        write()
        end = time.time() + 20
        # Small counts remain; what was written goes in the background.
        while (left := sum(n for f, n in shuffled_bytes(spark).items() if f not in before)) > 20_000 and time.time() < end:
            time.sleep(0.2)
        assert left <= 20_000


def test_rows_in_order_of_ids_are_not_shuffled(spark, revisions, tmp_path, monkeypatch):
    monkeypatch.setattr(revision_table, "FILE_ROWS", 10)
    many = many_revisions(spark, revisions)
    ranged = many.withColumn("id_range", revision_table.id_range(width=500))
    assert revision_table._gathered(ranged)
    revision_table.write_revisions(many, str(tmp_path / "table"), width=500)
    assert column(revision_table.read_revisions(spark, str(tmp_path / "table")), "rev_id") == column(many, "rev_id")
    monkeypatch.setattr(revision_table, "FILE_ROWS", 100)
    assert not revision_table._gathered(ranged)
