"""Sources, sinks and streaming: S2(S3(x)) = x, API flattening, stream result = batch result."""

import datetime as dt
import json
import random

from corpus_ledger.operators import changes as C
from corpus_ledger.session import work_path
from corpus_ledger.sources import io as IO
from corpus_ledger.sources.schemas import ENTRIES, TOKEN_IMPACTS, TOP_TOKENS, TRAINING_METADATA

T0 = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)


def test_json_round_trip(spark):
    e = spark.createDataFrame([(1, "Test Page", "test123", "rev1", T0, "h1", "added", False, None, None),
                               (2, "Rev", "test123_9", "9", T0, "h2", "added", True, "test123", 1)], ENTRIES)
    m = spark.createDataFrame([(1, 1, True, T0, "ckpt", 1.234, 0.567), (2, 2, False, None, None, None, None)],
                              TRAINING_METADATA)
    h = spark.createDataFrame([(1, 1, 100)], TOKEN_IMPACTS)
    t = spark.createDataFrame([(1, 1, 42, 10, 3.14, 8, 12)], TOP_TOKENS)
    path = work_path(spark, "rt")
    IO.export_json(IO.nest_ledger(e, m, h, t), path)
    e2, m2, h2, t2 = IO.import_nested(IO.read_nested(spark, path))
    assert sorted(map(tuple, e2.collect())) == sorted(map(tuple, e.collect()))
    assert sorted(map(tuple, m2.collect())) == sorted(map(tuple, m.collect()))
    assert [tuple(r) for r in h2.collect()] == [(1, 1, 100)]
    assert [tuple(r) for r in t2.collect()] == [(1, 1, 42, 10, 3.14, 8, 12)]


def test_flatten_api_skips_missing_and_numbers_revisions(spark):
    body = ('{"query": {"pages": {"7": {"pageid": 7, "title": "Seven", "revisions": ['
            '{"revid": 30, "slots": {"main": {"*": "new"}}}, {"revid": 20, "slots": {"main": {"*": "old"}}}]},'
            ' "-1": {"title": "Nope", "missing": ""}}}}')
    df = spark.createDataFrame([(body,)], "body string")
    rows = sorted(tuple(r) for r in IO.flatten_api_pages(df).collect())
    assert rows == [("7", "Seven", "20", 2, "old"), ("7", "Seven", "30", 1, "new")]


def test_merges_from_text_drops_malformed(spark):
    lines = spark.createDataFrame([("t h",), ("a b c",), ("th e",), ("",)], "value string")
    got = [tuple(r) for r in IO.merges_from_text(lines).orderBy("rank").collect()]
    assert got == [(1, "t", "h"), (2, "th", "e")]


def test_stream_equals_batch(spark):
    from corpus_ledger.streaming.ledger_stream import FEED_SCHEMA, run_to_completion

    rows = [(i, f"p{i % 4}", f"t{i}", f"r{i}", dt.datetime(2024, 1, 1 + i // 6, i % 6), f"c{i}",
             ["added", "updated", "updated", "removed"][i % 4]) for i in range(18)]
    feed = spark.createDataFrame(rows, FEED_SCHEMA)
    base = work_path(spark, "st")
    for day in range(3):
        spark.createDataFrame([r for r in rows if r[4].day == 1 + day], FEED_SCHEMA) \
            .coalesce(1).write.parquet(f"{base}/feed/part={day}")
    got = run_to_completion(spark, f"{base}/feed/*", f"{base}/state", f"{base}/ckpt", max_files_per_trigger=1)
    want = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), feed).entries
    assert sorted(map(tuple, got.entries.collect())) == sorted(map(tuple, want.collect()))


def test_late_and_repeated_rows_give_the_batch_ledger(spark):
    """ST1: rows out of order over the batches, some of them twice, an invalid action, one page with half of all rows."""
    from corpus_ledger.streaming.ledger_stream import FEED_SCHEMA, page_store, run_to_completion

    rng = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"p{rng.randrange(12)}", f"t{i}", f"r{i}", dt.datetime(2024, 1, 1 + rng.randrange(9)),
             f"c{i}", rng.choice(["added", "updated", "updated", "removed", "other"])) for i in range(120)]
    base = work_path(spark, "late")
    sent = rows + rows[10:30]
    rng.shuffle(sent)
    for part in range(4):
        spark.createDataFrame(sent[part::4], FEED_SCHEMA).coalesce(1).write.parquet(f"{base}/feed/part={part}")
    got = run_to_completion(spark, f"{base}/feed/*", f"{base}/state", f"{base}/ckpt", max_files_per_trigger=1)
    valid, _ = C.validate_domain(spark.createDataFrame(rows, FEED_SCHEMA))
    want = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), valid)
    assert sorted(map(tuple, got.entries.collect())) == sorted(map(tuple, want.entries.collect()))
    assert sorted(map(tuple, got.metadata.collect())) == sorted(map(tuple, want.metadata.collect()))
    store = page_store(spark, f"{base}/state")
    assert store.versions("base")  # the changes were folded on the way
    # A repeated batch replaces its own version.
    last = max(store.versions("delta"))
    again = spark.read.parquet(f"{store.path}/delta={last}").drop("_version").checkpoint()
    store.commit(again, last)
    assert store.read().count() == got.entries.count()


def test_stored_ledger_writes_what_changes(spark):
    """A batch on one page in a hundred writes about a hundredth, and does not shuffle the stored rows."""
    from corpus_ledger.sources.ledger_store import LedgerStore

    def feed(ids, revision, action):
        day = dt.datetime(2024, 1, 1 + revision)
        return spark.createDataFrame([(i, f"p{i}", f"t{i}", f"r{revision}", day, f"text {i} {revision}", action) for i in ids],
                                     "event_id long, page_id string, title string, revision_id string, ts timestamp_ntz, content string, action string")

    store = LedgerStore(spark, work_path(spark, "ledger"), ENTRIES)
    parts = [feed(range(5000), 0, "added"), feed(range(0, 5000, 100), 1, "updated"), feed([5, 6, 9001], 2, "updated"),
             feed([5, 9001], 3, "added")]
    state = C.LedgerVersion(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA))
    for version, part in enumerate(parts):
        C.upsert_stored(store, part, version)
        state = C.upsert_pages(state.entries, state.metadata, part)
        state = C.LedgerVersion(state.entries.checkpoint(), state.metadata.checkpoint())
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, state.entries.collect()))
    counts = [spark.read.parquet(f"{store.path}/delta={v}").count() for v in store.versions("delta")]
    assert counts[-3:] == [50, 3, 0] and store.versions("base") == [1]
    plan = store.lookup(feed([1, 2], 4, "updated"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("Join") == plan.count("strategy=broadcast") == 3


def test_old_versions_go(spark):
    from corpus_ledger.sources.ledger_store import LedgerStore
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("n", T.LongType())])
    store = LedgerStore(spark, work_path(spark, "kept"), schema, compact_at=0.4)
    want = {}
    for version in range(12):
        rows = {f"p{i}": version * 100 + i for i in range(version % 5, 10, 2)}
        want |= rows
        store.commit(spark.createDataFrame(list(rows.items()), schema), version)
        assert {r.page_id: r.n for r in store.read().collect()} == want
    bases, deltas = store.versions("base"), store.versions("delta")
    assert len(bases) == 2 and min(deltas) > bases[0] and len(deltas) < 12


def test_read_text_folder(spark, tmp_path):
    """A folder of <page_key>.txt files read whole, keyed by file name."""
    (tmp_path / "12.txt").write_text("first line\nsecond line\n", encoding="utf-8")
    (tmp_path / "12_99.txt").write_text("revision text", encoding="utf-8")
    got = {r.page_key: r.text for r in IO.read_page_texts(spark, str(tmp_path), fmt="text").collect()}
    assert got == {"12": "first line\nsecond line\n", "12_99": "revision text"}
    pages = spark.createDataFrame([("12",), ("13",)], "page_id string")
    assert IO.attach_texts(pages, IO.read_page_texts(spark, str(tmp_path), fmt="text")).count() == 1
    kept = IO.attach_texts(pages, IO.read_page_texts(spark, str(tmp_path), fmt="text"), missing="keep")
    assert kept.filter("text IS NULL").count() == 1


def test_document_objects_are_emitted_once(spark, tmp_path):
    """However often the objects are used, the document itself is not read again."""
    from corpus_ledger.sources.json_document import document_objects

    path = tmp_path / "ledger.json"
    entries = [{"id": i, "title": '}"\\' * (i % 4)} for i in range(30)]
    path.write_text(json.dumps({"entries": entries}))
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "90")  # objects cross block ends
        found = document_objects(spark, str(path), "entries")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    for _ in range(2):
        assert sorted((json.loads(r.object) for r in found.collect()), key=lambda e: e["id"]) == entries


def test_document_is_read_by_many_tasks(spark, tmp_path):
    """One JSON document with braces, quotes and escapes in strings, other arrays, and any block size."""
    from corpus_ledger.sources.json_document import document_objects

    rng = random.Random(2)
    nasty = ['}', '{"entries": [{', '\\', '"', '\\"}', ']', 'é}ü{', '\n', '"}]}', 'plain', '"entries": [', '\u2028']
    entries = [{"id": i, "title": "".join(rng.choice(nasty) for _ in range(rng.randint(0, 6))),
                "training_metadata": {"used_in_training": True, "model_checkpoint": "}", "token_impact": {
                    "top_tokens": [{"token_id": t, "position": 1, "impact": 0.5, "context": [0, 2]} for t in range(i % 3)],
                    "total_tokens": 3}} if i % 2 else None} for i in range(60)]
    document = {"before": [{"id": -1, "entries": [{"id": -2}]}], "name": "} [", "entries": entries, "after": [{"id": -3}], "n": {"a": [{}]}}
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for indent in (2, None):
            path = str(tmp_path / f"ledger{indent}.json")
            with open(path, "w", encoding="utf-8") as f:
                json.dump(document, f, indent=indent, ensure_ascii=False)
            for size in ("53", "700", "100000"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "1")
                found = document_objects(spark, path, "entries")
                got = sorted((json.loads(r.object) for r in found.collect()), key=lambda e: e["id"])
                assert got == entries, (indent, size)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
            read = IO.read_nested(spark, path, multi_line_document=True)
            assert read.rdd.getNumPartitions() > 10
            assert sorted((r.id, r.title) for r in read.collect()) == [(e["id"], e["title"]) for e in entries]
        empty = tmp_path / "empty.json"
        empty.write_text('{"entries": []}')
        assert document_objects(spark, str(empty), "entries").count() == 0
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_category_members(spark):
    body = '{"query": {"categorymembers": [{"pageid": 1, "title": "A"}, {"pageid": 2, "title": "B"}]}}'
    rows = [tuple(r) for r in IO.flatten_category_members(spark.createDataFrame([(body,)], "body string"))
            .orderBy("pos").collect()]
    assert rows == [(0, 1, "A"), (1, 2, "B")]


def test_schema_check_reports_nulls_and_missing(spark):
    from corpus_ledger.operators import audit as I
    from corpus_ledger.sources.schemas import TOKEN_IMPACTS

    h = spark.createDataFrame([(1, None), (2, 5)], "id long, metadata_id long")
    rows = {r.column: (r.status, r.null_count) for r in I.schema_check({"token_impacts": h},
                                                                       {"token_impacts": TOKEN_IMPACTS}).collect()}
    assert rows == {"id": ("ok", 0), "metadata_id": ("ok", 1), "total_tokens": ("missing_column", None)}


def test_snapshot_stream_equals_sequential_ingest(spark):
    """ST1 snapshot mode: the stream's final ledger equals the ingest plan applied file by file."""
    from corpus_ledger.streaming.ledger_stream import FEED_SCHEMA, apply_snapshots, run_to_completion

    rows = [(i, f"p{i % 3}", f"t{i % 3}", f"r{i}", dt.datetime(2024, 1, 1 + i // 5, i % 5), f"c{i}", "updated")
            for i in range(15)]
    base = work_path(spark, "snap")
    batches = []
    for day in range(3):
        part = [r for r in rows if r[4].day == 1 + day]
        batches.append(part)
        spark.createDataFrame(part, FEED_SCHEMA).coalesce(1).write.parquet(f"{base}/feed/part={day}")
    got = run_to_completion(spark, f"{base}/feed/*", f"{base}/state", f"{base}/ckpt", max_files_per_trigger=1,
                            mode="snapshots")
    state = C.LedgerVersion(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA))
    for part in batches:
        state = apply_snapshots(spark.createDataFrame(part, FEED_SCHEMA), state, None)
        state = C.LedgerVersion(state.entries.checkpoint(), state.metadata.checkpoint())
    assert sorted(map(tuple, got.entries.collect())) == sorted(map(tuple, state.entries.collect()))
    revs = [r for r in got.entries.collect() if r.is_revision]
    assert len(revs) == 15 and all(r.parent_id == r.page_id.split("_")[0] for r in revs)
