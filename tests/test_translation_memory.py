"""A translation memory that is kept over runs."""
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import translation_memory as TM


@pytest.fixture
def memory(spark, tmp_path):
    name = TM.open_memory(spark, str(tmp_path / "memory"), 4)
    yield name
    spark.sql(f"DROP TABLE {name}")


# lambdas, so that workers need not import this file
_upper = lambda: lambda sentences: sentences.str.upper()
_never = lambda: lambda sentences: 1 / 0                   # noqa: E731


def _rows(spark, sentences):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "id int, original_sentence string")


def _run(rows, memory, name, factory=_upper):
    got = TM.translate_kept(rows, factory, memory, name, run_col="run")
    return {r.id: (r.translated_sentence, r.run) for r in got.collect()}


def test_translates_new_sentences_only(spark, memory):
    first = _run(_rows(spark, ["a b", None, "", "a b", "ç\nd"]), memory, "one")
    t = ">>POR<< "
    assert first == {0: (t + "A B", "one"), 1: (None, None), 2: (t, "one"), 3: (t + "A B", "one"), 4: (t + "Ç\nD", "one")}
    second = _run(_rows(spark, ["a b", "new", "ç\nd"]), memory, "two")
    assert second == {0: (t + "A B", "one"), 1: (t + "NEW", "two"), 2: (t + "Ç\nD", "one")}
    # nothing is new: the translator gets no sentence
    assert _run(_rows(spark, ["new", "a b"]), memory, "three", _never) == {0: (t + "NEW", "two"), 1: (t + "A B", "one")}
    assert spark.table(memory).count() == 4


def test_hot_sentence(spark, memory):
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("id"),
                                      F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("original_sentence"))
    got = TM.translate_kept(rows, _upper, memory, "one")
    assert got.count() == 20_000
    want = F.concat(F.lit(">>POR<< "), F.upper("original_sentence"))
    assert got.filter(~F.col("translated_sentence").eqNullSafe(want)).count() == 0


def test_entry_of_two_runs_at_once_does_not_double_rows(spark, memory):
    _run(_rows(spark, ["a"]), memory, "one")
    spark.table(memory).withColumn("run", F.lit("other")).write.mode("append").format("parquet").bucketBy(4, "h").saveAsTable(memory)
    assert _run(_rows(spark, ["a", "a"]), memory, "two", _never) == {0: (">>POR<< A", "one"), 1: (">>POR<< A", "one")}


def test_memory_outlives_its_table_name_and_empty_rows(spark, tmp_path):
    path = str(tmp_path / "memory")
    name = TM.open_memory(spark, path, 4)
    assert _run(_rows(spark, []), name, "none") == {}
    _run(_rows(spark, ["a"]), name, "one")
    spark.sql(f"DROP TABLE {name}")
    assert TM.open_memory(spark, path, 4) == name
    assert _run(_rows(spark, ["a"]), name, "two", _never) == {0: (">>POR<< A", "one")}
    spark.sql(f"DROP TABLE {name}")


def test_memory_is_not_shuffled(spark, memory):
    """With the session's shuffle partitions as buckets, no exchange lies above the scan of the memory."""
    _run(_rows(spark, [f"s{i}" for i in range(50)]), memory, "one")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        rows = _rows(spark, [f"s{i}" for i in range(50)])
        plan = TM.translate_kept(rows, _upper, memory, "two")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert "Bucketed: true" in plan
    below, seen = None, 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if "Exchange hashpartitioning" in line:
            below = depth
        elif below is not None and depth <= below:
            below = None
        if "Bucketed: true" in line:
            seen += 1
            assert below is None
    assert seen
