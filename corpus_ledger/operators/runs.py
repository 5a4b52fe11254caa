"""Training runs, examples and model outputs with JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_ledger.functions.ranks import global_row_number
from corpus_ledger.operators.changes import _max_id, assert_domain
from corpus_ledger.sources.schemas import (MODEL_OUTPUTS, RUN_STATUSES, TRAINING_EXAMPLES, TRAINING_RUNS,
                                           conform)

# JSON objects keep the types and the nesting of their values.
METRICS_MAP = "map<string,variant>"


def create_runs(runs: DataFrame, requests: DataFrame, at: str, order: list[str]) -> DataFrame:
    """Register runs: status running, metrics ``{}``, hyperparameters (a struct or map column
    ``hyperparameters``) stored as JSON text; ids continue after the current maximum in ``order``."""
    base = _max_id(runs)
    new = global_row_number(requests, order, "_rn")
    new = new.select(
        (F.col("_rn") + F.lit(base)).alias("id"), "model_name", "base_model",
        F.to_json("hyperparameters").alias("hyperparameters"),
        (F.col("git_commit") if "git_commit" in requests.columns else F.lit(None).cast("string")).alias("git_commit"),
        F.lit("running").alias("status"), F.lit(at).cast("timestamp_ntz").alias("ts"), F.lit("{}").alias("metrics"))
    return conform(runs, TRAINING_RUNS, strict=False).unionByName(conform(new, TRAINING_RUNS))


def json_values(text: Column) -> Column:
    """A JSON object as a map from key to the value's JSON text."""
    return F.transform_values(F.from_json(text, METRICS_MAP), lambda k, v: F.to_json(v))


def merge_json_maps(old: Column, new: Column) -> Column:
    """Right side wins per key: old entries whose key is in ``new`` are dropped, then ``new`` appended."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def fold_updates(updates: DataFrame, order: list[str]) -> DataFrame:
    """One update per id: the last status in ``order``, and per metric key the last value. Keys are folded
    one by one, so a run with very many updates is pre-aggregated before the shuffle."""
    text = F.col("metrics") if dict(updates.dtypes)["metrics"] == "string" else F.to_json("metrics")
    rows = updates.select("id", "status", json_values(text).alias("values"), F.struct(*order, "status").alias("at"))
    last = rows.groupBy("id").agg(F.max_by("status", "at").alias("_status"), F.max(F.col("values").isNotNull()).alias("_any"))
    keys = rows.select("id", "at", F.explode("values").alias("key", "value")).groupBy("id", "key").agg(F.max_by("value", "at").alias("value"))
    merged = keys.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_values"))
    empty = F.create_map().cast("map<string,string>")
    return last.join(merged, "id", "left").select("id", "_status", F.when(F.col("_any"), F.coalesce("_values", empty)).alias("_values"))


def update_run_status(runs: DataFrame, updates: DataFrame, strict: bool = True, order: list[str] | None = None) -> DataFrame:
    """R2: set status and merge metrics (``updates``: id, status, metrics as JSON text, struct, map or null).

    Several updates of one id are folded in ``order`` (columns of ``updates``; by status when not given).
    """
    u = fold_updates(assert_domain(updates, "status", RUN_STATUSES) if strict else updates, order or [])
    j = runs.join(u, "id", "left")
    old = F.coalesce(json_values(F.col("metrics")), F.create_map().cast("map<string,string>"))
    values = F.transform_values(merge_json_maps(old, F.col("_values")), lambda k, v: F.parse_json(v))
    merged = F.when(F.col("_values").isNotNull(), F.to_json(values)).otherwise(F.col("metrics"))
    return j.withColumn("status", F.coalesce("_status", "status")).withColumn("metrics", merged) \
        .drop("_status", "_values")


def add_examples(examples: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Append examples; rows without input or target are dropped; type defaults to ``general``
    and metadata to ``{}``."""
    base = _max_id(examples)
    ok = new.dropna(subset=["input_text", "target_text"])
    ok = global_row_number(ok, order, "_rn")
    meta = F.col("metadata") if "metadata" in new.columns else F.lit(None).cast("string")
    rows = ok.select((F.col("_rn") + F.lit(base)).alias("id"), "run_id", "input_text", "target_text",
                     F.coalesce(F.col("example_type"), F.lit("general")).alias("example_type"),
                     F.coalesce(meta, F.lit("{}")).alias("metadata"))
    return conform(examples, TRAINING_EXAMPLES, strict=False).unionByName(conform(rows, TRAINING_EXAMPLES))


def add_model_outputs(outputs: DataFrame, new: DataFrame, at: str, order: list[str]) -> DataFrame:
    """Append model outputs (metadata JSON text, ``{}`` when absent)."""
    base = _max_id(outputs)
    rows = global_row_number(new, order, "_rn")
    meta = F.col("metadata") if "metadata" in new.columns else F.lit(None).cast("string")
    rows = rows.select((F.col("_rn") + F.lit(base)).alias("id"), "run_id", "input_text", "output_text",
                       F.lit(at).cast("timestamp_ntz").alias("ts"), F.coalesce(meta, F.lit("{}")).alias("metadata"))
    return conform(outputs, MODEL_OUTPUTS, strict=False).unionByName(conform(rows, MODEL_OUTPUTS))


def run_details(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Runs for the given ids with JSON columns parsed into maps."""
    r = runs.join(ids.select("id").distinct(), "id", "left_semi")
    return r.withColumn("hyperparameters_map", F.from_json("hyperparameters", METRICS_MAP)) \
            .withColumn("metrics_map", F.from_json("metrics", METRICS_MAP))


def run_summaries(runs: DataFrame) -> DataFrame:
    """Run summaries, newest first."""
    return runs.select("id", "model_name", "base_model", "status", "ts").orderBy(F.desc("ts"), F.desc("id"))


def list_examples(examples: DataFrame, run_id: int | None = None, example_type: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """Examples filtered by run and type, ordered by id, optionally the first ``limit``."""
    e = examples
    if run_id is not None:
        e = e.filter(F.col("run_id") == run_id)
    if example_type is not None:
        e = e.filter(F.col("example_type") == example_type)
    e = e.orderBy("id")
    return e.limit(limit) if limit else e
