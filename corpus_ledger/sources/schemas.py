"""Fixed schemas of the ledger tables and the domains of their enumerated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerated domains of the ledger.
ACTIONS = ("added", "updated", "removed")
RUN_STATUSES = ("running", "completed", "failed")

ENTRIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("page_id", T.StringType()),
    T.StructField("revision_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("is_revision", T.BooleanType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("revision_number", T.IntegerType()),
])

TRAINING_METADATA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("entry_id", T.LongType()),
    T.StructField("used_in_training", T.BooleanType()),
    T.StructField("training_timestamp", T.TimestampNTZType()),
    T.StructField("model_checkpoint", T.StringType()),
    T.StructField("average_loss", T.DoubleType()),
    T.StructField("relative_loss", T.DoubleType()),
])

TOKEN_IMPACTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("metadata_id", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
])

TOP_TOKENS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("token_impact_id", T.LongType()),
    T.StructField("token_id", T.LongType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("impact", T.DoubleType()),
    T.StructField("context_start", T.IntegerType()),
    T.StructField("context_end", T.IntegerType()),
])

LEGACY_TOKEN_IMPACT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("metadata_id", T.LongType()),
    T.StructField("token", T.StringType()),
    T.StructField("impact", T.DoubleType()),
])

TRAINING_RUNS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("model_name", T.StringType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("hyperparameters", T.StringType()),
    T.StructField("git_commit", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("metrics", T.StringType()),
])

TRAINING_EXAMPLES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.LongType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("target_text", T.StringType()),
    T.StructField("example_type", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

MODEL_OUTPUTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.LongType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("output_text", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("metadata", T.StringType()),
])

# Nested ledger document (one JSON object per entry; the reference wraps them in {"entries": [...]}).
TOP_TOKEN_JSON = T.StructType([
    T.StructField("token_id", T.LongType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("impact", T.DoubleType()),
    T.StructField("context", T.ArrayType(T.IntegerType())),
])
TOKEN_IMPACT_JSON = T.StructType([
    T.StructField("top_tokens", T.ArrayType(TOP_TOKEN_JSON)),
    T.StructField("total_tokens", T.LongType()),
])
TRAINING_METADATA_JSON = T.StructType([
    T.StructField("used_in_training", T.BooleanType()),
    T.StructField("training_timestamp", T.TimestampNTZType()),
    T.StructField("model_checkpoint", T.StringType()),
    T.StructField("average_loss", T.DoubleType()),
    T.StructField("relative_loss", T.DoubleType()),
    T.StructField("token_impact", TOKEN_IMPACT_JSON),
])
NESTED_ENTRY = T.StructType(
    [f for f in ENTRIES.fields] + [T.StructField("training_metadata", TRAINING_METADATA_JSON)]
)
NESTED_LEDGER = T.StructType([T.StructField("entries", T.ArrayType(NESTED_ENTRY))])

# API response of the page feed (pages keyed by page id, revisions newest first).
API_RESPONSE = T.StructType([
    T.StructField("query", T.StructType([
        T.StructField("pages", T.MapType(T.StringType(), T.StructType([
            T.StructField("pageid", T.LongType()),
            T.StructField("title", T.StringType()),
            T.StructField("missing", T.StringType()),
            T.StructField("revisions", T.ArrayType(T.StructType([
                T.StructField("revid", T.LongType()),
                T.StructField("timestamp", T.StringType()),
                T.StructField("slots", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
            ]))),
        ]))),
        T.StructField("categorymembers", T.ArrayType(T.StructType([
            T.StructField("pageid", T.LongType()),
            T.StructField("title", T.StringType()),
        ]))),
    ])),
])

LEDGER_TABLES = {
    "entries": ENTRIES,
    "training_metadata": TRAINING_METADATA,
    "token_impacts": TOKEN_IMPACTS,
    "top_tokens": TOP_TOKENS,
}
ALL_TABLES = dict(LEDGER_TABLES, token_impact=LEGACY_TOKEN_IMPACT, training_runs=TRAINING_RUNS,
                  training_examples=TRAINING_EXAMPLES, model_outputs=MODEL_OUTPUTS)


def conform(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Project ``df`` onto ``schema``: fixed column order and types.

    Missing columns raise in strict mode and become typed nulls otherwise; extra columns are dropped,
    so the Parquet scan below reads only the schema's columns.
    """
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing and strict:
        raise ValueError(f"missing columns {missing}")
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*cols)


def read_table(spark, path: str, schema: T.StructType) -> DataFrame:
    """Read one ledger table from Parquet and conform it to its fixed schema."""
    return conform(spark.read.parquet(path), schema)
