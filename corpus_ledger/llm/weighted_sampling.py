"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of weighted terms: its words, weighted by how often they occur. For a term of weight w the
hash of the term gives r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the term's sample value
is a = c exp(-r (t - b + 1)). Among competing terms the one with the smallest a is drawn, together with t:
two bags draw the same (term, t) with a probability equal to their generalised Jaccard similarity
sum(min) / sum(max).

A weight is cut into pieces of at most ``BLOCK``, the j-th piece being a term of its own: sum(min) and sum(max)
stay the same, and no frequent word outweighs the rest. The pieces compete in ``BINS`` bins, each always in the
bin that its hash names, so each is sampled once instead of once per signature value. ``likeness`` is the share
of agreeing bins among those that either text fills.

Defined results: null is the empty text; the empty signature is like the empty signature (1) and unlike any
other (0); equal texts have equal fingerprints; rows that repeat a doc_id are documents of their own, in the
order of their text's hash; a null doc_id comes first; the only document is its own next one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import WORD, documents, positions, stored

BINS = 64          # six bits of a signature value name the bin, 24 the draw
BLOCK = 2          # a term is sampled in pieces of at most this weight (a power of two)


def term_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the text's words, one per occurrence."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def pieces(text: str) -> Column:
    """One number per piece of a term: a hash of (term, piece) whose low bits hold the piece's weight less 1."""
    # Sorted hashes; a new term starts where the hash changes, and the place inside the term is the distance to
    # that start. The arrays are bound as lambda variables, so that no element step computes them again.
    starts = """transform(array(_h), h -> struct(h AS h, concat(
        filter(transform(h, (x, i) -> IF(i = 0 OR x <> h[i - 1], i, -1)), i -> i >= 0), array(size(h))) AS s))"""
    return F.expr(f"""
        flatten(transform({starts}, p -> flatten(transform(slice(p.s, 1, size(p.s) - 1), (at, i) ->
          transform(sequence(0, (p.s[i + 1] - at - 1) DIV {BLOCK}), j ->
            (xxhash64(p.h[at], j) & {-BLOCK}L) | (least({BLOCK}, p.s[i + 1] - at - j * {BLOCK}) - 1))))))
        """.replace("_h", text))


def draws(of: str) -> Column:
    """One sortable integer per piece: its bin, then ln a, then its draw; the arrays keep the order of the pieces."""
    unit = f"(0.5D + (xxhash64(p & {-BLOCK}L, {{}}) & 1099511627775L)) / 1099511627776D"
    u = [unit.format(k) for k in range(5)]
    sampled = f"""
        transform({of}, p -> struct(p & {-BLOCK}L AS h, IF(p & {BLOCK - 1}L = 0, 0D, ln(1D + (p & {BLOCK - 1}L))) AS lw,
            -ln({u[0]} * {u[1]}) AS r, ln(-ln({u[2]} * {u[3]})) AS lc, {u[4]} AS b))"""
    t = "floor(q.lw / q.r + q.b)"
    return F.expr(f"""
        transform({sampled}, q -> coalesce(shiftleft(shiftrightunsigned(q.h, 58), 55)
          | shiftleft(bigint(least(greatest((q.lc - q.r * ({t} - q.b + 1) + 96) * 16777216D, 0D), 2147483647D)), 24)
          | (xxhash64(q.h, {t}) & 16777215L), 0L))""")


def least_draws(packed: str) -> Column:
    """The signature: per bin the draw of the smallest a, as a sorted array of (bin, draw) integers."""
    return F.expr(f"""
        transform(array(sort_array({packed})), p -> transform(filter(transform(p, (x, i) ->
            IF(i = 0 OR shiftright(x, 55) <> shiftright(p[i - 1], 55), x, -1L)), x -> x >= 0),
          x -> int(shiftleft(shiftright(x, 55), 24) | (x & 16777215L))))[0]""")


def with_signatures(df: DataFrame, x: str, y: str, x_out: str, y_out: str) -> DataFrame:
    """Add the signatures of two texts of a row; a piece that both hold is sampled once."""
    hashed = df.withColumn("_hx", term_hashes(F.col(x))).withColumn("_hy", term_hashes(F.col(y)))
    held = hashed.withColumn("_px", pieces("_hx")).withColumn("_py", pieces("_hy"))
    parts = (held.withColumn("_only_x", F.array_except("_px", "_py")).withColumn("_both", F.array_intersect("_px", "_py"))
             .withColumn("_only_y", F.array_except("_py", "_px"))
             .withColumn("_all", F.concat("_only_x", "_both", "_only_y")).withColumn("_d", draws("_all")))
    return (parts.withColumn(x_out, least_draws("slice(_d, 1, size(_only_x) + size(_both))"))
            .withColumn(y_out, least_draws("slice(_d, size(_only_x) + 1, size(_both) + size(_only_y))"))
            .drop("_hx", "_hy", "_px", "_py", "_only_x", "_both", "_only_y", "_all", "_d"))


def likeness(a: str, b: str) -> Column:
    """Share of agreeing bins among those filled in either signature."""
    same = F.size(F.array_intersect(a, b))
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 24)), F.transform(b, lambda x: F.shiftright(x, 24))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(same / bins)


def fingerprint(signature: str) -> Column:
    """The signature as text: eight hex digits per filled bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, n_chars, next_doc_id and ``head``: as many first code points of the next document, in
    ascending doc_id, as a quarter of this text has (or all of it); after the last document comes the first."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = rows.select("row", "doc_id", F.xxhash64("text").alias("_hash"), F.char_length("text").alias("_n"))
    ranked, n = positions(slim, ["doc_id", "_hash"], "_rank")
    order = stored(ranked.select("row", "_rank", "_n"), "order")
    before = order.select((F.pmod(F.col("_rank") + 1, F.lit(max(n, 1)))).alias("_rank"),
                          F.col("row").alias("before"), F.floor(F.col("_n") / 4).cast("int").alias("_take"))
    follows = stored(order.select("row", "_rank").join(before, "_rank").select("row", "before", "_take"), "follows")
    # Each text travels once, to its own row number; only its head goes on to the document before it. Both uses read
    # the same columns, so that Spark shuffles them once.
    heads = rows.join(follows, "row").select(F.col("before").alias("row"), F.expr("left(text, _take)").alias("head"),
                                             F.col("row").alias("next_row"), F.col("doc_id").alias("next_doc_id"))
    return rows.join(heads, "row").withColumn("n_chars", F.char_length("text").cast("long"))


def op9_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(documents(spark, sf_dir))
    edited = F.concat(F.expr("left(text, CAST(n_chars AS INT) - CAST(floor(n_chars / 4) AS INT))"), F.col("head"))
    pairs = pairs.withColumn("edited", edited)
    signed = with_signatures(pairs, "text", "edited", "signature", "edited_signature")
    slim = stored(signed.select("row", "next_row", "doc_id", "next_doc_id", "n_chars",
                                F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                                "signature", "edited_signature"), "signatures")
    after = slim.select(F.col("row").alias("next_row"), F.col("signature").alias("next_signature"))
    out = slim.join(after, "next_row")
    return out.select("doc_id", "n_chars", "next_doc_id", "edited_sha256", fingerprint("signature").alias("fingerprint"),
                      fingerprint("edited_signature").alias("edited_fingerprint"),
                      likeness("signature", "edited_signature").alias("near_edited"),
                      likeness("signature", "next_signature").alias("near_next"))
