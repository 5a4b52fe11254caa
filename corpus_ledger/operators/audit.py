"""Integrity audits and statistics (I1-I8). Spark enforces no keys, so these are the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_ledger.operators.changes import _side_by_side


def orphan_counts(metadata: DataFrame, headers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Headers whose metadata is missing, tokens whose header is missing."""
    oh = headers.join(metadata.select(F.col("id").alias("metadata_id")), "metadata_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("orphan_headers"))
    ot = tokens.join(headers.select(F.col("id").alias("token_impact_id")), "token_impact_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("orphan_tokens"))
    return _side_by_side(oh, ot)


def foreign_key_check(tables: dict[str, DataFrame],
                      keys: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """One row per foreign key (child, fk, parent, pk) with its violation count and the smallest
    offending key as a sample."""
    keys = keys or [("training_metadata", "entry_id", "entries", "id"),
                    ("token_impacts", "metadata_id", "training_metadata", "id"),
                    ("top_tokens", "token_impact_id", "token_impacts", "id")]
    # Every parent key and child key as one row (foreign key, value): one aggregation finds the values that only
    # children have. A hot value is summed in each task before the exchange.
    tagged = None
    for i, (child, fk, parent, pk) in enumerate(keys):
        sides = [(child, fk, 1, 0), (parent, pk, 0, 1)]
        for table, column, is_child, is_parent in sides:
            part = tables[table].filter(F.col(column).isNotNull()).select(
                F.lit(i).alias("fk"), F.col(column).cast("long").alias("k"), F.lit(is_child).cast("long").alias("n"),
                F.lit(is_parent).alias("known"))
            tagged = part if tagged is None else tagged.unionByName(part)
    values = tagged.groupBy("fk", "k").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    bad = (F.col("known") == 0) & (F.col("n") > 0)
    found = values.groupBy("fk").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("violations"),
                                     F.min(F.when(bad, F.col("k"))).alias("sample_key"))
    spark = tagged.sparkSession
    names = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)],
                                  "fk int, child_table string, fk_column string, parent_table string, pk_column string")
    return names.join(F.broadcast(found), "fk", "left").select(  # one row per foreign key
        "child_table", "fk_column", "parent_table", "pk_column", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
        "sample_key")


def impact_coverage(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct pages having impact headers, and having top tokens."""
    em = entries.select(F.col("id").alias("entry_id")).join(metadata.select("entry_id", F.col("id").alias("metadata_id")),
                                                           "entry_id")
    eh = em.join(headers.select("metadata_id", F.col("id").alias("token_impact_id")), "metadata_id")
    et = eh.join(tokens.select("token_impact_id").distinct(), "token_impact_id", "left_semi")
    return _side_by_side(eh.agg(F.count_distinct("entry_id").alias("pages_with_headers")),
                         et.agg(F.count_distinct("entry_id").alias("pages_with_tokens")))


# The fields a token needs, and those that hold whole numbers.
TOKEN_FIELDS = ["token_id", "position", "impact", "context_start", "context_end"]
WHOLE_FIELDS = ["token_id", "position"]


def token_rules(tokens: DataFrame) -> dict[str, F.Column]:
    """I4: rule name -> does the token break it: fields missing, ids and positions not whole, context reversed."""
    rules = {f"{c}_missing": F.col(c).isNull() for c in TOKEN_FIELDS}
    types = dict(tokens.dtypes)
    for c in WHOLE_FIELDS:
        if types[c] not in ("tinyint", "smallint", "int", "bigint"):
            whole = F.try_to_number(F.col(c), F.lit("S999999999999999999")).isNotNull() if types[c] == "string" \
                else F.col(c) == F.floor(c)
            rules[f"{c}_not_whole"] = F.col(c).isNotNull() & ~F.coalesce(whole, F.lit(False))
    rules["context_reversed"] = F.coalesce(F.col("context_start") > F.col("context_end"), F.lit(False))
    return rules


def token_validity(tokens: DataFrame) -> DataFrame:
    """I4: per header, its tokens and those that break a rule."""
    bad = F.lit(False)
    for broken in token_rules(tokens).values():
        bad = bad | broken
    return tokens.groupBy("token_impact_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(bad).alias("n_invalid"),
        F.bool_and(~bad).alias("valid"))


def token_violations(tokens: DataFrame) -> DataFrame:
    """I4: one row per token and rule that it breaks."""
    names = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in token_rules(tokens).items()]))
    return tokens.select("token_impact_id", *TOKEN_FIELDS, F.explode(names).alias("rule"))


def schema_check(tables: dict[str, DataFrame], expected: dict[str, T.StructType]) -> DataFrame:
    """Every expected table and column present with its type, plus the null count of each present
    column (one aggregation pass per table). One row per expected column."""
    parts = []
    for name, schema in expected.items():
        df = tables.get(name)
        have = {} if df is None else {f.name: f.dataType.simpleString() for f in df.schema.fields}
        present = [f for f in schema.fields if f.name in have]
        if df is not None and present:
            nulls = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in present])
            stacked = nulls.select(F.explode(F.map_from_arrays(
                F.array(*[F.lit(f.name) for f in present]),
                F.array(*[F.col(f.name) for f in present]))).alias("column", "null_count"))
        else:
            stacked = None
        rows = []
        for f in schema.fields:
            actual = have.get(f.name)
            status = "missing_table" if df is None else (
                "missing_column" if actual is None else ("ok" if actual == f.dataType.simpleString() else "type_differs"))
            rows.append((name, f.name, f.dataType.simpleString(), actual, status))
        spark = next(iter(tables.values())).sparkSession
        meta = spark.createDataFrame(rows, "table string, column string, expected_type string, "
                                           "actual_type string, status string")
        # ``stacked`` has one row per column of the table: a broadcast of a fixed-size list.
        part = meta.join(F.broadcast(stacked), "column", "left") if stacked is not None \
            else meta.withColumn("null_count", F.lit(None).cast("long"))
        parts.append(part.select("table", "column", "expected_type", "actual_type", "status", "null_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def size_statistics(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Counts, average key size, tokens per header (0 without headers), average and total token text size.

    Numbers are rendered with a fixed format before measuring, so the size does not depend on an
    engine's float-to-text rules. The column names are fixed values of the report.
    """
    e = entries.agg(F.count(F.lit(1)).alias("total_entries"),
                    F.round(F.avg(F.length("page_id") + F.length("content_hash")), 6).alias("avg_entry_size_bytes"))
    m = metadata.agg(F.count_if(F.col("used_in_training")).alias("entries_with_training"))
    h = headers.agg(F.count(F.lit(1)).alias("entries_with_token_impact"))
    t = tokens.agg(F.count(F.lit(1)).alias("total_token_impacts"),
                   F.round(F.avg(F.length(F.col("token_id").cast("string")) + F.length(F.col("position").cast("string"))
                                 + F.length(F.format_string("%.6f", "impact"))), 6).alias("avg_impact_size_bytes"))
    s = _side_by_side(_side_by_side(e, m), _side_by_side(h, t))
    total = F.coalesce(F.col("avg_impact_size_bytes"), F.lit(0.0)) * F.col("total_token_impacts") / (1024 * 1024)
    return s.withColumn("avg_tokens_per_impact", F.when(
        F.col("entries_with_token_impact") > 0,
        F.round(F.col("total_token_impacts") / F.col("entries_with_token_impact"), 6)).otherwise(F.lit(0.0))) \
        .withColumn("total_token_impact_mb", F.round(total, 6))


def readiness(entries: DataFrame, metadata: DataFrame, headers: DataFrame | None, tokens: DataFrame | None) -> DataFrame:
    """One-row verdict; rules checked in order, the first failing one is named. A table that does not
    exist (None) fails first and counts as empty."""
    from corpus_ledger.operators.changes import empty_like
    from corpus_ledger.sources.schemas import TOKEN_IMPACTS, TOP_TOKENS

    missing = [("token_impacts_missing", F.lit(headers is None)), ("top_tokens_missing", F.lit(tokens is None))]
    headers = empty_like(entries.sparkSession, TOKEN_IMPACTS) if headers is None else headers
    tokens = empty_like(entries.sparkSession, TOP_TOKENS) if tokens is None else tokens
    o = orphan_counts(metadata, headers, tokens)
    c = impact_coverage(entries, metadata, headers, tokens)
    n = _side_by_side(headers.agg(F.count(F.lit(1)).alias("n_headers")),
                      tokens.agg(F.count(F.lit(1)).alias("n_tokens")))
    s = _side_by_side(_side_by_side(o, c), n)
    rules = missing + [
             ("no_token_impacts", F.col("n_headers") == 0),
             ("no_top_tokens", F.col("n_tokens") == 0),
             ("orphan_token_impacts", F.col("orphan_headers") > 0),
             ("orphan_top_tokens", F.col("orphan_tokens") > 0),
             ("no_pages_with_tokens", F.col("pages_with_tokens") == 0)]
    first = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        first = F.when(cond, F.lit(name)).otherwise(first)
    return s.select(first.isNull().alias("ready"), first.alias("first_failure"), "n_headers", "n_tokens",
                    "orphan_headers", "orphan_tokens", "pages_with_tokens")


def table_schemas(tables: dict[str, DataFrame]) -> DataFrame:
    """I8: the columns of each table in order, with their types."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, place int, column string, type string")


def table_samples(tables: dict[str, DataFrame], order: dict[str, list[str]], n: int = 5, whole: bool = False) -> DataFrame:
    """I8: per table its row count and the first ``n`` rows (fixed order) rendered as JSON: the ordering
    columns, or with ``whole`` all columns."""
    parts = []
    for name, df in tables.items():
        cnt = df.agg(F.count(F.lit(1)).alias("rows"))
        sample = df.orderBy(*order[name]).limit(n)
        shown = df.columns if whole else order[name]
        w = sample.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("sample_key"))
        both = cnt.withColumn("_k", F.lit(1)).join(w.withColumn("_k", F.lit(1)), "_k", "left")  # an empty table keeps its row
        parts.append(both.select(F.lit(name).alias("table"), "rows", "sample_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
