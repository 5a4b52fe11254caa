"""Driver contract: entry() runs on sf0.001; every oracle names a registered query."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_entries > 0


def test_oracles_cover_registered_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_fast_queries_run_on_smallest_scale(spark):
    q = entry.queries()
    for name in ["q07_group_by_action", "l04_fingerprint", "i01_orphans", "m09_l2_norm", "t02_word_frequencies"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 0
