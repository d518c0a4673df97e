"""Registered queries against their SQL, and the pipeline stage by stage, over whole small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries as Q
from tests.check_oracle import TABLES, canon

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query(spark, duck, name):
    df, want = Q.QUERIES[name](spark, FOLDER), duck.sql(Q.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, state = docs.columns, {r["doc_id"] for r in docs.collect()}
    kept = {name: {r["doc_id"] for r in Q.QUERIES[name](spark, FOLDER).where(rule).collect()} for name, rule in (("op4_quality_rules", "kept"), ("op6_decontamination", "NOT contaminated"))}
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= state and left
        steps.append((state, left))
        state = left
    assert steps[0][1] == kept["op4_quality_rules"]
    assert steps[3][1] == steps[3][0] & kept["op6_decontamination"]
    good = {r[0] for r in duck.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    assert steps[1][0] & good <= steps[1][1]  # the classifier loses none of the good
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())

    def shingles(i):
        w = texts[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))}

    sets = {i: shingles(i) for i in steps[2][0]}
    for i in steps[2][0] - steps[2][1]:
        assert any(j != i and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for j in sets)
    stay = sorted(steps[2][1])
    assert not any(len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for k, i in enumerate(stay) for j in stay[:k])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in out} == state
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 1024 for r in out)


def test_stages_leave_clashing_columns_and_repeated_rows_alone(spark, tmp_path):
    """Columns named like results keep their values; rows alike go the same way; rows without an id are judged too."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    for i, name in enumerate(("n_words", "kept", "n_hit", "score", "predicted", "varied", "component_id", "contaminated", "_kept")):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + i)
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        rows = [tuple(r) for r in docs.collect()]
        assert set(rows) <= given and rows, name
        assert all(rows.count(r) == 2 for r in rows if r[0] is not None and r[0] < 20), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.where("piece = 0").count() == docs.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], empty.schema), str(tmp_path)).count() == 0, name


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
