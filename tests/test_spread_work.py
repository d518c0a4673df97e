"""How the work of combinations, small ranges and growing files divides."""

from collections import Counter
from types import SimpleNamespace

from pyspark.sql import functions as F

from millrace.catalog import streams
from millrace.operators import pivots
from millrace.plans import ordered
from millrace.sources import ranges


def _per_task(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_combinations_are_dealt_over_tasks(spark, monkeypatch):
    """Before, adaptive execution put all pairs into one task, since the input is small."""
    monkeypatch.setattr(ordered, "RESULTS", 1 << 12)
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 1).alias("k"))
    spark.conf.set("millrace.comboTile", "20")
    try:
        for permutations, n in ((True, 2 * 200 * 199), (False, 200 * 199)):
            got = pivots.combinations(df, "id", 2, "a,b", "k", permutations=permutations)
            tasks = _per_task(got)
            assert sum(tasks) == n and max(tasks) < 0.3 * n
            assert Counter(r["k"] for r in got.collect()) == {1: n // 2, None: n // 2}
    finally:
        spark.conf.unset("millrace.comboTile")


def test_small_ranges_share_tasks(spark, tmp_path):
    """Before, each range was a task, up to 20,000."""
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
    got = ranges.read_lines(spark, str(tmp_path), size=16)
    assert got.rdd.getNumPartitions() <= ranges.PARALLEL
    assert [r["value"] for r in got.orderBy("line").collect()] == [f"line {i}" for i in range(3000)]


def test_growing_files_are_as_many_as_the_documents_need(spark, tmp_path):
    """Before, four tasks wrote all documents."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    streams._write_lines(SimpleNamespace(documents=docs), str(tmp_path / "lines"), False)
    files = list((tmp_path / "lines").iterdir())
    assert len(files) == 7 and sum(f.read_text().count("\n") for f in files) == 120_000
