"""Records with line breaks over many splits against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from tapeloom.sources import files, spanning


def write(path, rows, end="\n", quote=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    writer = csv.writer(out, quoting=quote, lineterminator=end)
    writer.writerow([f"c{i}" for i in range(3)])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def some_rows(n, seed):
    rnd = random.Random(seed)
    piece = ["plain", 'a "quoted" word', "two\nlines", "\n", '"', '""\n""', "comma, here", "", "é ß\n漢字", 'ends with "', '"begins', "\n\n\n", ",", '",', ',"\n']
    return [[f"row {i}", "".join(rnd.choices(piece, k=rnd.randint(0, 4))), rnd.choice(["x", ""])] for i in range(n)]


def cells(rows):
    return sorted([tuple(c or None for c in r) for r in rows], key=repr)


SCHEMA = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(3)])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed, quote", [(1, csv.QUOTE_MINIMAL), (2, csv.QUOTE_ALL)])
def test_many_splits(small_splits, tmp_path, seed, quote):
    rows, other = some_rows(150, seed), some_rows(20, seed + 10)
    write(tmp_path / "a.csv", rows, quote=quote)
    write(tmp_path / "b.csv", other, quote=quote)
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = spanning.read_spanning_csv(small_splits, str(tmp_path), SCHEMA)
    assert cells(got.collect()) == cells(rows + other)
    assert got.columns == ["c0", "c1", "c2"]


def test_one_record_over_many_splits(small_splits, tmp_path):
    rows = [["first", "x", "y"], ["long", "line of text\n" * 300, "z"], ["last", '"', ""]]
    write(tmp_path / "a.csv", rows)
    assert cells(spanning.read_spanning_csv(small_splits, str(tmp_path), SCHEMA).collect()) == cells(rows)


def test_carriage_returns_and_stray_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'c0,c1,c2\r\n1,5" pipe,x\r\n2,"a\r\nb",y\r\n\r\n3,it"s,"z"\r\n4,"open to the end\nof the file,')
    got = spanning.read_spanning_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()
    assert sorted(r.c0 for r in got) == ["1", "2", "3", "4"]
    by = {r.c0: r for r in got}
    assert by["1"].c1 == '5" pipe' and by["1"].c2 == "x" and by["2"].c1.split() == ["a", "b"] and by["2"].c2 == "y" and by["3"].c2 == "z"


def test_maps_of_a_line(spark):
    def plain(line, inside):
        i, start = 0, not inside
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
                start = False
            else:
                if c == '"' and start:
                    inside = True
                start = c == ","
            i += 1
        return inside

    rnd = random.Random(5)
    lines = ["".join(rnd.choices(['"', ",", "a", "b c"], k=rnd.randint(0, 9))) for _ in range(3000)] + ["x" * 200_000, '"' * 50_001]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    maps = spanning._ends_inside(df["line"])
    got = df.select("line", maps["from_out"].alias("o"), maps["from_in"].alias("i")).collect()
    assert all(r.o == plain(r.line, False) and r.i == plain(r.line, True) for r in got)


def test_empty_file_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("c0,c1,c2\n")
    assert spanning.read_spanning_csv(spark, str(tmp_path), SCHEMA).count() == 0


def test_table_reader_takes_both(spark, tmp_path):
    write(tmp_path / "a.csv", [["1", "plain", "x"]])
    assert cells(files.read_table(spark, str(tmp_path), SCHEMA).collect()) == cells(files.read_table(spark, str(tmp_path), SCHEMA, line_breaks=True).collect())
