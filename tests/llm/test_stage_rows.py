"""Stages decide on rows: null and repeated ids, clashing column names, items without an id, executors without the package."""

import hashlib
import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from corpus_ledger.llm import decontamination, entropy_mixing, minmax_dedup
from corpus_ledger.llm.common import numbered, reads_in_place

ROOT = Path(__file__).resolve().parents[2]
WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, source string, _id long, _hit long, _gone long, _row long, _copies long, _ROW_ long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA).coalesce(1)


def test_rows_without_an_id_are_judged(spark):
    text, other = " ".join(WORDS), " ".join(reversed(WORDS))
    leak = "one two three four five six seven eight nine ten"
    docs = docs_of(spark, [(1, text), (None, text), (None, f"x {leak} y"), (2, other), (2, f"{leak} again"), (None, other), (3, None)])
    kept = minmax_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(1, text), (None, f"x {leak} y"), (2, other), (2, f"{leak} again"), (3, None)]
    benchmark = spark.createDataFrame([(None, leak), (7, "short item"), (8, None)], "item_id long, text string")
    clean = decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert [(r.doc_id, r.text) for r in clean.collect()] == [(1, text), (None, text), (2, other), (None, other), (3, None)]
    mixed = entropy_mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = [r.text for r in mixed.collect()]
    assert set(got) <= {r.text for r in docs.collect()} and got.count(None) == 1


def test_row_numbers_hold_in_every_plan(spark, tmp_path):
    """A scan, a scan with a filter, and rows that are no scan: numbers are distinct and belong to the same rows."""
    spark.range(1000).selectExpr("id", "cast(id as string) AS text").repartition(7).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    for df, in_place in ((scan, True), (scan.filter("id % 3 = 0"), True), (scan.repartition(5), False),
                         (scan.groupBy("id").agg(F.first("text").alias("text")), False)):
        assert reads_in_place(df) == in_place
        rows = numbered(df, "_row")
        both = rows.select("_row", "id").join(rows.select("_row", F.col("text").alias("t")), "_row")
        assert both.filter("cast(id as string) = t").count() == df.count() == rows.select("_row").distinct().count()


def test_items_without_an_id(spark):
    """Their windows are hit; together they count as one item that the list of ids does not name."""
    docs = docs_of(spark, [(1, "a b c d"), (2, "c d e"), (3, "x")])
    benchmark = spark.createDataFrame([(None, "a b"), (None, "d"), (5, "c d"), (6, "q")], "item_id long, text string")
    rows = {r.id: (r.n_words, list(r.starts), list(r.ends), list(r["items"]))
            for r in decontamination.benchmark_matches(docs, benchmark, window=2).collect()}
    assert rows == {1: (4, [0, 2, 3], [2, 4, 4], ["5", None]), 2: (3, [0, 1], [2, 2], ["5", None]), 3: (1, [], [], [])}
    out = decontamination.benchmark_matches(docs, benchmark, window=2).mapInArrow(
        decontamination._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string").collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in out}[1] == (4, 2, hashlib.sha256(b"5").hexdigest())


# The queries of the training-data operators on executors that are other processes and cannot import the package.
ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.executor.memory", "1500m")
         .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
def importable(_):
    import importlib.util
    yield int(importlib.util.find_spec("corpus_ledger") is not None)
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [0]
from corpus_ledger.llm.queries import QUERIES
for name in sys.argv[1:]:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    names = ["op8_decontamination", "op11_conversation_repair", "op12_vector_clusters", "op13_embedding_dedup"]
    script = tmp_path / "elsewhere.py"
    script.write_text(ELSEWHERE.format(root=str(ROOT), shared=str(tmp_path / "shared")))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_LOCAL_DIRS")}
    env |= {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, str(script), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
