"""Readers, sinks and the stream on small files."""

import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import named_files, readers, schemas, sinks, workbooks
from tidemark.streaming import daily, pairing, rounds


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_telemetry_and_metadata_pair_by_name(spark, tmp_path):
    line = ",".join(["{i}", "{i}.5", "0", "0", "1", "{c}", *["1.0"] * 11])
    body = "\n".join(["," + ",".join(f"h{k}" for k in range(16)), *(line.format(i=i, c=c) for i, c in enumerate([3, 0, 1]))])
    write(tmp_path / "2019-01-24_batch_CH7.csv", body)
    write(tmp_path / "~2019-01-24_batch_CH7.csv", body)
    fields = ["0", "t", "d", "6", "1", "0", "0", "0", "x\\2018-A-3_6C.sdu", '"a,b"', "EL0150", *["0"] * 3, "v", *["0"] * 3, *["f"] * 4, "1.0", "2.0"]
    write(tmp_path / "2019-01-24_batch_CH7_Metadata.csv", ",".join(c.split()[0] for c in schemas.METADATA.split(", ")) + "\n" + ",".join(fields))
    samples = readers.telemetry(spark, str(tmp_path), "2019-01-24")
    about = readers.metadata(spark, str(tmp_path), "2019-01-24")
    assert samples.count() == 3
    both = readers.cells(samples, about)
    assert {(r["barcode"], r["channel"], r["policy"]) for r in both.collect()} == {("EL0150", 7, "3_6C")}
    assert readers.from_first_cycle_zero(samples).count() == 2
    assert readers.without_denied(samples, samples.select("file").limit(1), ["file"]).count() == 0


def test_rounds_come_from_file_names_and_blanks_are_null(spark, tmp_path):
    for k in range(2):
        write(tmp_path / f"{k}.csv", "﻿3.6,4.0,5.6,4.1,900\n4.0,4.0,4.4,4.8," if k else "3.6,4.0,5.6,4.1,800")
    found = readers.rounds(spark, str(tmp_path)).groupBy("round").agg(F.count("life").alias("n"), F.count("*").alias("rows")).orderBy("round").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1), (1, 1, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3.6, 4.16049)], "a double, b double")
    sinks.fixed_csv(df, str(tmp_path / "fixed"))
    assert spark.read.text(str(tmp_path / "fixed")).first()[0] == "3.600,4.160"
    for life in (1.0, 2.0):
        sinks.append_log(spark.createDataFrame([("a", 0, life)], "run string, round int, life double"), str(tmp_path / "log"))
    assert tuple(sinks.read_log(spark, str(tmp_path / "log"), 2).first()) == ("a", 2.0, None)
    sinks.save_state(df, str(tmp_path / "state"), 0)
    sinks.save_state(df, str(tmp_path / "state"), 1)
    assert sinks.load_state(spark, str(tmp_path / "state"), before=1).count() == 1
    cycles = spark.createDataFrame([(1, 2, 0.9), (1, 1, 1.0)], "unit int, k int, q double")
    packed = sinks.nested(spark.createDataFrame([(1,), (2,)], "unit int"), cycles, "unit", "k").orderBy("unit").collect()
    assert [c["k"] for c in packed[0]["cycles"]] == [1, 2] and packed[1]["cycles"] is None


def test_stream_summaries(spark, tmp_path):
    folder = tmp_path / "in"
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def arrive(*rows):
        spark.createDataFrame(rows, "ts string, u int, v double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(str(folder))
        windows = daily.windowed(daily.arriving(spark, str(folder), "ts timestamp, u int, v double"), "ts", ["u"], "v")
        return [(r["n"], r["mean"]) for r in daily.run(spark, windows, out, at).orderBy("window_start").collect()]

    assert arrive(("2024-01-01 01:00:00", 1, 2.0), ("2024-01-01 05:00:00", 1, 4.0), ("2024-01-02 01:00:00", 1, 9.0)) == []
    # a late sample counts until two days after its window; then the window is closed
    assert arrive(("2024-01-01 06:00:00", 1, 6.0), ("2024-01-04 01:00:00", 1, 1.0)) == [(3, 4.0)]
    assert arrive(("2024-01-01 07:00:00", 1, 7.0), ("2024-01-09 01:00:00", 1, 1.0)) == [(3, 4.0), (1, 9.0), (1, 1.0)]


def test_samples_without_metadata_fail_or_stay(spark):
    samples = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "file string, v double")
    about = spark.createDataFrame([("a", 7), ("c", 9)], "file string, channel int")
    with pytest.raises(PySparkException, match="no metadata for"):
        readers.cells(samples, about).collect()
    assert readers.cells(samples.filter("file = 'a'"), about).collect()[0]["channel"] == 7
    kept = readers.cells(samples, about, strict=False)
    assert sorted((r["v"], r["channel"]) for r in kept.collect()) == [(1.0, 7), (2.0, None), (3.0, None)] and kept.columns == ["file", "v", "channel"]
    assert {tuple(r) for r in readers.unpaired(samples, about).collect()} == {("b", "samples"), (None, "samples"), ("c", "metadata")}


def test_one_column_of_lives(spark, tmp_path):
    write(tmp_path / "lives.csv", "900\n\n1000")
    assert [r["life"] for r in readers.csv(spark, str(tmp_path / "lives.csv"), schemas.LIVES, header=False).collect()] == [900, 1000]


def test_readers_see_the_old_round_until_the_new_one_is_published(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda low: spark.range(low, low + 3)
    seen = lambda: sorted(r["id"] for r in sinks.load_state(spark, root).collect())
    with pytest.raises(ValueError):
        sinks.load_state(spark, root)
    sinks.save_state(rows(0), root, 0)
    entry = sinks.write_state(rows(10), root, 0)
    reader = sinks.load_state(spark, root)
    assert seen() == [0, 1, 2]
    sinks.publish_state(spark, root, entry)
    assert seen() == [10, 11, 12] and sorted(r["id"] for r in reader.collect()) == [0, 1, 2]
    sinks.save_state(rows(20), root, 1)
    assert sinks.vacuum(spark, root) == 1 and seen() == [10, 11, 12, 20, 21, 22]
    assert sinks.load_state(spark, root, before=1).count() == 3


def test_writers_that_publish_at_once_lose_nothing(spark, tmp_path):
    root, turns = str(tmp_path), []

    def change(entries):
        if not turns:
            turns.append(1)
            sinks.save_state(spark.range(2), root, 5)  # another writer is faster
        return [*entries, {"round": 6, "path": "x"}]

    sinks.publish(spark, root, change)
    assert [e["round"] for e in sinks.manifest(spark, root)[1]] == [5, 6]


def test_named_files(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 7, F.lit(".csv")).alias("file"), "id", F.when(F.col("id") % 2 == 0, 'a "b", c').alias("v"))
    named_files.write_csv(df, str(tmp_path / "out"), "file", ["id"], ["id", "v"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"f{k}.csv" for k in range(7)]
    lines = (tmp_path / "out" / "f3.csv").read_text().splitlines()
    assert lines[0] == "id,v" and [int(x.split(",")[0]) for x in lines[1:]] == list(range(3, 1000, 7))
    back = readers.csv(spark, str(tmp_path / "out"), "id long, v string").filter("v is not null")
    assert back.count() == 500 and {r["v"] for r in back.select("v").distinct().collect()} == {'a "b", c'}
    named_files.write_csv(df.filter("id < 7"), str(tmp_path / "out"), "file", ["id"], ["id"], header=False)
    assert (tmp_path / "out" / "f3.csv").read_text() == "3\n"


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    # the task that meets the name it can't write has written files before it, and so have others
    df = spark.range(1000).select(F.when(F.col("id") == 900, "z/../../x").otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("name"), F.lit(b"x").alias("content"), "id")
    with pytest.raises(Exception, match="not a file name"):
        named_files.write_contents(df, str(tmp_path / "out"), ["id"])
    assert not any((tmp_path / "out").rglob("*")) and not (tmp_path / "x").exists()


def hand_made_workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{workbooks.DOCUMENT}"><sheets><sheet name="B &amp; C" sheetId="4" r:id="r9"/><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}/relationships"><Relationship Id="r1" Target="/xl/worksheets/one.xml"/><Relationship Id="r9" Target="worksheets/nine.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>')
        book.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row><c><v>1.5</v></c><c t="s"><v>1</v></c></row><row r="7"><c r="AB7" t="b"><v>1</v></c><c r="AC7"/><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
        book.writestr("xl/worksheets/nine.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row r="2"><c r="C2" t="s"><v>0</v></c><c r="D2" t="str"><v>f</v></c><c r="E2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_cells_of_a_workbook_with_shared_strings(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(hand_made_workbook())
    got = [tuple(r)[1:] for r in workbooks.cells(spark, str(tmp_path)).collect()]
    assert got == [
        ("B & C", 2, 3, "text", "plain", None), ("B & C", 2, 4, "text", "f", None), ("B & C", 2, 5, "text", "in", None), ("A", 1, 1, "number", "1.5", 1.5), ("A", 1, 2, "text", "two runs", None),
        ("A", 7, 28, "boolean", "1", 1.0), ("A", 7, 30, "error", "#N/A", None),
    ]
    assert all(workbooks.column_number(workbooks.column_letters(k)) == k for k in range(1, 2000))


def test_workbook_round_trip_of_odd_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "<a> & 'b'", 0.1), (2, None, None), (3, "  blanks\nand lines ", -1e300)], "i int, s string, v double")
    workbooks.write(workbooks.as_cells(df, "t.xlsx", 'a "sheet"', ["i"]), str(tmp_path))
    back = workbooks.sheet(workbooks.cells(spark, str(tmp_path)), 'a "sheet"', "i int, s string, v double").orderBy("row").select("i", "s", "v").collect()
    assert list(map(tuple, back)) == list(map(tuple, df.collect()))


def test_streamed_rounds_after_a_restart_and_with_a_file_that_comes_twice(spark, tmp_path):
    folder, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    schema = "experiment string, round int, outcome double"
    one = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("b", 0, 5.0)], schema).coalesce(1)
    two = spark.createDataFrame([("a", 1, 10.0), (None, 0, 1.0)], schema).coalesce(1)
    one.write.parquet(folder)
    assert rounds.run(spark, folder, schema, out, at).count() == 2
    one.write.mode("append").parquet(folder)
    two.write.mode("append").parquet(folder)
    rounds.run(spark, folder, schema, out, at)
    got = {(r["experiment"], r["round"]): (r["n"], r["total"], r["n_so_far"], r["total_so_far"]) for r in rounds.run(spark, folder, schema, out, at).collect()}
    assert got == {("a", 0): (2, 3.0, 2, 3.0), ("b", 0): (1, 5.0, 1, 5.0), ("a", 1): (1, 10.0, 3, 13.0), (None, 0): (1, 1.0, 1, 1.0)}


@pytest.mark.parametrize("first", ["samples", "about"])
def test_pairs_in_any_order_of_arrival(spark, tmp_path, first):
    left, right, out, at = (str(tmp_path / x) for x in ("l", "r", "out", "at"))
    samples = spark.createDataFrame([(k, f"f{k % 4}", 1_700_000_000 + k) for k in range(12)], "i int, file string, s long").select("i", "file", F.timestamp_seconds("s").alias("t"))
    about = spark.createDataFrame([("f0", 1, 1_700_000_005), ("f2", 3, 1_700_000_000)], "file string, channel int, s long").select("file", "channel", F.timestamp_seconds("s").alias("at"))
    none = samples.limit(0), about.limit(0)
    early, late = ((samples, none[1]), (none[0], about)) if first == "samples" else ((none[0], about), (samples, none[1]))
    for a, b in (early, late):
        a.write.mode("append").parquet(left)
        b.write.mode("append").parquet(right)
        pairs = pairing.paired(daily.arriving(spark, left, "i int, file string, t timestamp"), daily.arriving(spark, right, "file string, channel int, at timestamp"), "file", "t", "at", "1 minute")
        pairing.run(spark, pairs, out, at)
    far = F.timestamp_seconds(F.lit(1_800_000_000))
    spark.range(1).select(F.lit(-1).alias("i"), F.lit("-").alias("file"), far.alias("t")).write.mode("append").parquet(left)
    spark.range(1).select(F.lit("+").alias("file"), F.lit(0).alias("channel"), far.alias("at")).write.mode("append").parquet(right)
    got = pairing.run(spark, pairs, out, at).filter("i >= 0")
    want = samples.join(about, "file", "left")
    assert sorted((r["i"], r["channel"], r["unpaired"]) for r in got.collect()) == sorted((r["i"], r["channel"], r["channel"] is None) for r in want.collect())
