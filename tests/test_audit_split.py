"""Audits, the split by counting, dataset sources and jobs: edge cases beside the SQL comparison."""

import hashlib
import json

from pyspark.sql import functions as F

from corpus_ledger.operators import audit as I
from corpus_ledger.operators import metrics as M
from corpus_ledger.session import work_path
from corpus_ledger.sources import io as IO


def test_foreign_keys_in_one_pass(spark):
    """A parentless key that half of the rows hold, null keys, and a key with no violation; one exchange of the values."""
    tables = {"entries": spark.createDataFrame([(1,), (2,)], "id long"),
              "training_metadata": spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, entry_id long"),
              "token_impacts": spark.createDataFrame([(1, 1), (2, 2)], "id long, metadata_id long"),
              "top_tokens": spark.range(200).select(F.when(F.col("id") < 100, 77).otherwise(F.col("id") % 3).cast("long")
                                                    .alias("token_impact_id"))}
    out = I.foreign_key_check(tables)
    rows = {r.child_table: (r.violations, r.sample_key) for r in out.collect()}
    zeros = len([i for i in range(100, 200) if i % 3 == 0])
    assert rows == {"training_metadata": (1, 9), "token_impacts": (0, None), "top_tokens": (100 + zeros, 0)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "BroadcastHashJoin" in plan


def test_token_rules(spark):
    t = spark.createDataFrame([(1, 5.0, "3", 0.1, 0, 2), (1, 5.5, "x", 0.1, 0, 2), (2, None, "4", None, 3, 1), (2, 1.0, "-7", 1.0, None, 1)],
                              "token_impact_id long, token_id double, position string, impact double, context_start int, context_end int")
    bad = sorted((r.token_impact_id, r.rule) for r in I.token_violations(t).collect())
    assert bad == [(1, "position_not_whole"), (1, "token_id_not_whole"), (2, "context_reversed"), (2, "context_start_missing"),
                   (2, "impact_missing"), (2, "token_id_missing")]
    assert {r.token_impact_id: (r.n_tokens, r.n_invalid, r.valid) for r in I.token_validity(t).collect()} == {1: (2, 1, False), 2: (2, 2, False)}


def test_readiness_names_missing_tables(spark):
    e = spark.createDataFrame([(1,)], "id long")
    m = spark.createDataFrame([(1, 1)], "id long, entry_id long")
    h = spark.createDataFrame([(1, 1, 3)], "id long, metadata_id long, total_tokens long")
    for headers, tokens, failure in ((None, None, "token_impacts_missing"), (h, None, "top_tokens_missing")):
        row = I.readiness(e, m, headers, tokens).first()
        assert (row.ready, row.first_failure) == (False, failure)


def test_split_by_counting_equals_a_sort(spark):
    """Any size and share, repeated keys, one bucket or many."""
    for n, share, digits in ((0, 0.1, 4), (1, 0.1, 4), (50, 0.0, 4), (50, 1.0, 4), (5000, 0.3, 1), (5000, 0.1, 4)):
        pages = spark.createDataFrame([(f"p{i}",) for i in range(n)], "page_id string")
        kept, M.BUCKET_DIGITS = M.BUCKET_DIGITS, digits
        try:
            ranked = {r.page_id: (r.split_rank, r.split) for r in M.split_train_val(pages, share, 7).collect()}
            chosen = {r.page_id: r.split for r in M.split_select(pages, share, 7).collect()}
        finally:
            M.BUCKET_DIGITS = kept
        order = sorted((f"p{i}" for i in range(n)), key=lambda p: (hashlib.sha256(f"{p}7".encode()).hexdigest(), p))
        train = int(n * (1 - share))
        assert ranked == {p: (i, "train" if i <= train else "val") for i, p in enumerate(order, 1)}
        assert chosen == {p: s for p, (_, s) in ranked.items()}


def test_split_moves_no_page_by_range(spark):
    pages = spark.range(1000).select(F.col("id").cast("string").alias("page_id"))
    assert "rangepartitioning" not in M.split_train_val(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in M.split_select(pages)._jdf.queryExecution().executedPlan().toString()


def test_documents_and_title_arrays(spark):
    titles = ['a "q" b', "] [", "é\n", None, ""]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "page_id string, title string").repartition(3)
    path = work_path(spark, "titles")
    IO.write_titles(rows, path, with_mapping=False, arrays=True)
    got = [r.title for r in IO.read_title_arrays(spark, f"{path}/titles").collect()]
    assert sorted(got) == sorted(t for t in titles if t is not None)
    IO.write_documents(rows, f"{path}/documents", "entries")
    found = [e for r in spark.read.text(f"{path}/documents", wholetext=True).collect() for e in json.loads(r.value)["entries"]]
    assert sorted(e["page_id"] for e in found) == ["0", "1", "2", "3", "4"]


def test_threshold_of_a_hot_page(spark):
    """One page with most rows, ties, one value only, huge and tiny values: equal to sorting each page."""
    import random

    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(rng.randrange(4))) for _ in range(500)]
    rows += [("same", -2.5)] * 300 + [("one", 7.0), ("wide", 1e308), ("none", None), ("none", float("nan"))]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(400)]
    df = spark.createDataFrame(rows, "page_id string, impact double").repartition(5)
    values = {}
    for page, x in rows:
        if x is not None and x == x:
            values.setdefault(page, []).append(abs(x))
    want = {p: (len(v), sorted(v)[int(len(v) * 0.95)]) for p, v in values.items()}
    for few, buckets in ((10, 16), (4096, 1024)):
        got = {r.page_id: (r.n, r.threshold) for r in M.threshold_rows(df, "page_id", "impact", few=few, buckets=buckets).collect()}
        assert got == want


def test_dropout_batches_repeat(spark):
    """The same epoch draws the same pieces whatever the partitions, another epoch draws others; no dropout, plain merges."""
    from corpus_ledger.operators import tokens as TK
    from corpus_ledger.plans.dataset import page_sequences

    pages = spark.createDataFrame([("a", "the theme that then"), ("b", "attic cat"), ("c", None)], "page_id string, text string")
    merges = spark.createDataFrame([(1, "t", "h"), (2, "th", "e"), (3, "a", "t")], "rank int, left string, right string")
    vocab = TK.extend_vocab(TK.initial_vocab(TK.word_frequencies(pages.filter("text IS NOT NULL")), 5100, 1), merges)

    def ids(df, **options):
        return {r.page_id: list(r.input_ids) for r in page_sequences(df, df, vocab, merges, **options).collect()}

    first = ids(pages, dropout=0.5, seed=1)
    assert first == ids(pages.repartition(3), dropout=0.5, seed=1) and first != ids(pages, dropout=0.5, seed=2)
    assert ids(pages, dropout=0.0) == ids(pages) and first["c"] == [0]


def test_threshold_shuffles_no_row(spark, capsys):
    """Rows meet the pages' state by a broadcast, whatever Spark takes the state's size to be."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = spark.range(20_000).selectExpr("id % 2 AS page_id", "CAST(id AS double) AS impact")
        found = M.threshold_rows(rows, "page_id", "impact", few=100, buckets=16)
        found.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.page_id: r.threshold for r in found.collect()} == {0: 19000.0, 1: 19001.0}
    finally:
        spark.conf.set(key, before)
