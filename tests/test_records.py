"""Records of quoted files: equal to a plain reading, however the file is split."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files as FS
from corpusmill.sources import records as R


def write(path, rows, sep, end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def random_rows(rnd, n):
    words = ["plain", "two words", 'a "quoted" word', "line\nbreak", "x\n\ny", ",", "\t", '"', '""', "é\n\"", "many\nmore\nlines\n", ""]
    return [[f"r{i}"] + ["".join(rnd.choice(words) for _ in range(rnd.randrange(3))) for _ in range(rnd.randrange(1, 4))] for i in range(n)]


@pytest.mark.parametrize("sep", [",", "\t"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split_gives_the_same_records(spark, tmp_path, sep, end):
    rnd = random.Random(3)
    parts = [random_rows(rnd, 200), random_rows(rnd, 120)]
    for i, rows in enumerate(parts):
        write(tmp_path / f"part-{i}.csv", rows, sep, end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("61", "997", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = [r.fields for r in FS.read_records(spark, str(tmp_path), sep).orderBy("rec").collect()]
            assert got == [r for rows in parts for r in rows], size
            if size == "61":
                assert R._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_equal_to_the_multi_line_reader(spark, tmp_path):
    rnd = random.Random(4)
    rows = [r[:2] for r in random_rows(rnd, 150)]
    write(tmp_path / "t.csv", rows, ",")
    got = FS.read_delimited(spark, str(tmp_path / "t.csv"), ["a", "b"])
    want = spark.read.csv(str(tmp_path / "t.csv"), schema="a string, b string", quote='"', escape='"', multiLine=True)
    assert [(r.a, r.b) for r in got.orderBy("rec").collect()] == [tuple(r) for r in want.collect()]


def test_quotes_inside_of_fields_and_blank_lines(spark, tmp_path):
    """A quote that does not start a field opens nothing; empty lines are no records; an open quote ends with its file."""
    (tmp_path / "a.csv").write_text('5" pipe,x\n\n"in ""it""",y\n\r\nz,"open\nto the end\n')
    (tmp_path / "b.csv").write_text("next,file\n")
    got = FS.read_records(spark, str(tmp_path)).orderBy("rec").collect()
    assert [r.rec for r in got] == [0, 1, 2, 3] and [r.fields[0] for r in got] == ['5" pipe', 'in "it"', "z", "next"]
    assert not R.after_line('a,b"c', False, ",") and R.after_line('a,"b', False, ",") and not R.after_line('b",c', True, ",")
    assert R.after_line('b"",c', True, ",") and R.after_line('b",c,"', True, ",")


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert FS.read_records(spark, str(tmp_path / "e.csv")).count() == 0
    assert FS.read_delimited(spark, str(tmp_path / "e.csv"), ["a"]).filter(F.col("a").isNull()).count() == 0
