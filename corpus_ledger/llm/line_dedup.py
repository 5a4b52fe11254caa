"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

Lines are sets of words (lower case; spaces, tabs and carriage returns separate them). Words are ordered by
rarity; two lines of Jaccard similarity ``percent`` share a word among the first n - ceil(percent n) + 1 of
each (prefix filter), their sizes differ by no more than the
similarity allows (length filter), where the shared word stands bounds the overlap (positional filter), and
a word of only one set changes one bit between two 128-bit parity maps (bitmap filter). What is left is verified
on the whole sets. Of two linked lines the later one (by doc_id, then line) goes.

Rarity is counted over all lines: word hashes fall into ``2**BUCKET_BITS`` buckets, and a word ranks by its
bucket's count, then by its hash. Any fixed order keeps the join exact; the count only makes prefixes rare.

Classes meet by prefix word and by the octave of their size: one stands in the octave of its own size, and with the
words that a larger one may share also in those that the larger one's size may reach. So few pairs are looked at that
differ too much in size.

Near copies of one line come in groups whose links are as many as the group's pairs. Such links are counted without
the pairs: a class takes as its hub the class with the most lines among those that share two of the four words at either end
of the hash order. Two classes at distances d and e (words in only one set) from the same hub differ in at most d + e
words, so where that is little enough for their sizes they are linked for certain, and running counts over the
distances of a hub's members give each one its number. Any other linked pair of a hub's members shares a word of those
that tell its classes from the hub; such pairs meet by it, and these words alone decide. Only pairs without a common
hub go through the join by prefixes.

Texts are split into words once; the stored sets serve the counts, the prefixes and the verification.
Words and word sets are compared by hash (52 bits in prefixes, 64 bits in sets). Lines with equal sets are one class before the
join, so copies are never paired with each other. Only lines that may have an equal set are grouped for that, and only lines
whose class has copies or links are joined to it at the end: a broadcast bitmap of the keys lets the others pass
(``sieve``). AQE splits the join's partitions where many classes share a prefix word.

Defined results: a null text has no lines; a line without words is neither compared nor removed; a null
doc_id sorts first; rows that repeat a doc_id count as separate documents in the order of their text's hash;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_ledger.llm.common import documents, stored

PERCENT = 80
BUCKET_BITS = 16
# Fixed value: a key that fewer classes share gives no hub; their pairs are few.
HUB_CLASSES = 8
# Fixed value: see ``sieve``. More wanted rows only sift less well.
SIEVE_BITS = 24
# Word hashes repeat within a row group: a dictionary of up to 16 MB keeps two or three bytes of each.
COMPACT = {"compression": "snappy", "parquet.dictionary.page.size": str(1 << 24)}


def spaced(text: Column) -> Column:
    """Lower case, with tabs and carriage returns as spaces."""
    return F.replace(F.replace(F.lower(text), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def split_lines(rows: DataFrame) -> DataFrame:
    """row, id, hash (of the text), line (from 0), content, bytes."""
    lines = rows.select("row", "id", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.withColumn("bytes", F.octet_length("content"))


def with_set(lines: DataFrame) -> DataFrame:
    """Add ``set``, the sorted hashes of the line's distinct words, ``n``, its size, ``key``, its hash, and ``lid``, a
    number of the line that is fixed once the lines are stored; lines without words go."""
    words = F.array_distinct(F.transform(F.split(spaced(F.col("content")), " "), lambda w: F.xxhash64(w)))
    full = lines.filter(F.col("content").rlike("[^ \t\r]"))
    full = full.withColumn("set", F.sort_array(F.array_remove(words, F.xxhash64(F.lit("")))))
    return (full.drop("content").withColumn("n", F.size("set")).withColumn("key", F.xxhash64("set"))
            .withColumn("lid", F.monotonically_increasing_id()))


def bucket_of(word: Column) -> Column:
    return F.shiftrightunsigned(word, 64 - BUCKET_BITS).cast("int")


def rarity_levels(lines: DataFrame) -> Column:
    """A constant array with one number per bucket, 2**BUCKET_BITS in all whatever the input: the lines with its
    words, in steps of a third of a power of two."""
    bucket = bucket_of(F.col("w")).alias("bucket")
    counts = lines.select(F.explode("set").alias("w")).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.floor(F.log2("n") * 3) + 1, F.lit(127)).cast("int").alias("level")
    levels = [1] * (1 << BUCKET_BITS)
    for r in counts.select("bucket", level).collect():
        levels[r["bucket"]] = r["level"]
    return constants(levels, "tinyint")


def constants(numbers: list[int], kind: str) -> Column:
    """A constant array of integers of that type."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def word_classes(lines: DataFrame, levels: Column, percent: int) -> DataFrame:
    """One row per distinct word set of the stored ``lines``: cid (lid of its first line), key, n, low (a 64-bit map, each
    word changes one bit), high (the same of half of the words, null for up to 64 words), prefix (32-bit hashes of its
    rarest words, by level, then by 52 bits of the hash), ends (hashes of two words each at either end of the set),
    first (place of its first line), copies (lines)."""
    def ranked(word: Column) -> Column:
        level = F.shiftleft(F.get(levels, bucket_of(word)).cast("long"), 52)
        # Never null; said so, Spark sorts plain longs.
        return F.coalesce(level.bitwiseOR(word.bitwiseAND(F.lit((1 << 52) - 1))), F.lit(0).cast("long"))

    def map_of(bits: list[int]) -> Column:
        """Changed by a word at the bit that its hash modulo 128 has in ``bits``."""
        table = constants(bits, "long")
        return F.aggregate("set", F.lit(0).cast("long"), lambda b, w: b.bitwiseXOR(F.get(table, w.bitwiseAND(F.lit(127)).cast("int"))))

    bits = [1 << i for i in range(63)] + [-1 << 63]
    low, high = map_of(bits + bits), F.when(F.col("n") > 64, map_of([0] * 64 + bits))
    twins = stored(lines.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key"), "twins")
    ordered = sieve(lines, twins, ["key"]).withColumn("ranked", F.sort_array(F.transform("set", ranked)))
    prefix = F.transform(F.expr(f"slice(ranked, 1, n - CAST(ceil(n * {percent} / 100D) AS INT) + 1)"), lambda w: F.hash(w))
    last = F.greatest(F.col("n") - 1, F.lit(1))
    at_end = [F.lit(1), F.least(F.lit(3), last), F.greatest(F.col("n") - 3, F.lit(1)), last]
    ends = F.array(*[F.hash(F.slice("set", at, F.lit(2))) for at in at_end])
    slim = ordered.select("key", "n", low.alias("low"), high.alias("high"), prefix.alias("prefix"), ends.alias("ends"),
                          place().alias("place"), "lid", "may")
    of_set = [F.any_value(c).alias(c) for c in ("n", "low", "high", "prefix", "ends")]
    found = slim.filter("may").groupBy("key").agg(F.min(F.struct("place", "lid")).alias("at"), *of_set, F.count(F.lit(1)).alias("copies"))
    names = ["key", "n", "low", "high", "prefix", "ends", "copies"]
    alone = slim.filter("NOT may").withColumn("copies", F.lit(1).cast("long"))
    return (alone.select(F.col("lid").alias("cid"), F.col("place").alias("first"), *names)
            .unionByName(found.select(F.col("at.lid").alias("cid"), F.col("at.place").alias("first"), *names)))


def place() -> Column:
    return F.struct("id", "hash", "row", "line")


def bits_apart(x: str, y: str) -> Column:
    """Bits that differ between two classes' maps: at most the words in only one of their sets."""
    of_half = F.coalesce(F.col(f"{x}.high").bitwiseXOR(F.col(f"{y}.high")), F.lit(0).cast("long"))
    return F.bit_count(F.col(f"{x}.low").bitwiseXOR(F.col(f"{y}.low")).bitwiseXOR(of_half)) + F.bit_count(of_half)


def sieve(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``may``, true for every row whose keys are in ``wanted`` (stored) and for few others, so that the rest
    need not be shuffled for a join with it: the keys' hashes are marked in a map of 16 bits or more per wanted row,
    2**SIEVE_BITS at most, broadcast as rows of 64 bits."""
    bits = min(SIEVE_BITS, max(6, (16 * wanted.count()).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(at, 6).alias("_word")
    marks = wanted.groupBy(word).agg(F.bit_or(mark).alias("_marks"))
    # Bounded: 2**(SIEVE_BITS - 6) rows.
    marked = rows.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    return marked.withColumn("may", F.coalesce(F.col("_marks").bitwiseAND(mark) != 0, F.lit(False))).drop("_word", "_marks")


def wanted_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose key is in ``wanted``, and few others."""
    return sieve(rows, wanted, [key]).filter("may").drop("may")


def attached(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``some`` (stored), which holds few of their keys: only rows that may have a match are shuffled."""
    sifted = sieve(rows, some, [key])
    return (sifted.filter("may").drop("may").join(some, key, "left")
            .unionByName(sifted.filter("NOT may").drop("may"), allowMissingColumns=True))


def sets_of(cids: DataFrame, lines: DataFrame) -> DataFrame:
    """cid, set: the word sets of some classes, read from their first lines, and few others."""
    cids = stored(cids.distinct(), "cids")
    return stored(wanted_rows(lines.select(F.col("lid").alias("cid"), "set"), cids, "cid"), "sets", **COMPACT)


def hub_members(classes: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """cid, hub (a class linked to it, itself for a hub), n, low, high, apart (the words in only one of both sets), slack: (100 + percent) times their
    number, less (100 - percent) times the class's size. Two members of a hub whose slacks add up to 0 or less are linked."""
    def spread(*columns: str) -> DataFrame:
        return classes.select(*columns, F.explode(F.array_distinct("ends")).alias("end"))

    busy = stored(spread().groupBy("end").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") >= HUB_CLASSES).select("end"), "ends")
    near_end = wanted_rows(spread("cid", "n", "low", "high", "copies"), busy, "end")
    hubs = near_end.groupBy("end").agg(F.max(F.struct("copies", "cid", "n", "low", "high")).alias("hub")).join(busy, "end").select("end", "hub.*")
    x, h = near_end.alias("x"), hubs.alias("h")
    both = F.col("x.n") + F.col("h.n")
    near = x.join(h, F.col("x.end") == F.col("h.end")).filter((100 + percent) * bits_apart("x", "h") <= (100 - percent) * both)
    maps = [F.any_value(f"x.{c}").alias(c) for c in ("low", "high")]
    chosen = stored(near.groupBy(F.col("x.cid").alias("cid"), F.col("x.n").alias("n")).agg(F.max(F.struct("h.copies", F.col("h.cid").alias("hub"))).alias("of"), *maps)
                    .select("cid", "of.hub", "n", "low", "high"), "hubs")
    sets = sets_of(chosen.select(F.explode(F.array("cid", "hub")).alias("cid")), lines)
    whole = (chosen.join(sets, "cid").select(F.col("cid").alias("member"), "hub", "n", "low", "high", F.col("set").alias("x_set"))
             .join(sets.alias("y"), F.col("hub") == F.col("y.cid")).select(F.col("member").alias("cid"), "hub", "n", "low", "high", "x_set", F.col("y.set").alias("y_set")))
    apart = F.concat(F.array_except("x_set", "y_set"), F.array_except("y_set", "x_set"))
    slack = ((100 + percent) * F.size("apart") - (100 - percent) * F.size("x_set")).cast("long")
    linked = (100 + percent) * F.size("apart") <= (100 - percent) * (F.size("x_set") + F.size("y_set"))
    return stored(whole.withColumn("apart", apart).filter(linked).select("cid", "hub", "n", "low", "high", "apart", slack.alias("slack")), "members")


def hub_links(members: DataFrame, percent: int) -> DataFrame:
    """The linked pairs (a, b) of members of a hub that are not linked for certain: the words apart from the hub that both
    have do not tell them from each other. A pair meets at the least of these words only."""
    words = members.select("*", F.explode("apart").alias("word"))
    x, y = words.alias("x"), words.alias("y")
    slack, shared = F.col("x.slack") + F.col("y.slack"), F.array_intersect("x.apart", F.col("y.apart"))
    may = (100 + percent) * bits_apart("x", "y") <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    near = (slack > 0) & may & (slack <= 2 * (100 + percent) * F.size(shared)) & (F.col("x.word") == F.array_min(shared))
    return (x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.word") == F.col("y.word")) & (F.col("x.cid") < F.col("y.cid")) & near)
            .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")))


def certain_links(members: DataFrame, firsts: DataFrame) -> DataFrame:
    """cid, links, later: of each member the number of its hub's other members that are linked to it for certain, and
    whether one of them comes first. A hub has as many rows in the window as its members have distances and sizes."""
    placed = members.select("cid", "hub", "slack").join(firsts, "cid")
    levels = placed.groupBy("hub", "slack").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    asked = levels.select("hub", (-F.col("slack")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("n"),
                          F.lit(None).cast(levels.schema["first"].dataType).alias("first"))
    up_to = Window.partitionBy("hub").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    told = (levels.select("hub", F.col("slack").alias("at"), F.lit(0).alias("asks"), "n", "first").union(asked)
            .select("hub", "at", "asks", F.sum("n").over(up_to).alias("n"), F.min("first").over(up_to).alias("before"))
            .filter("asks = 1 AND n > 0").select("hub", (-F.col("at")).alias("slack"), "n", "before"))
    itself = F.when(F.col("slack") <= 0, 1).otherwise(0)
    return (placed.join(told, ["hub", "slack"])
            .select("cid", (F.col("n") - itself).alias("links"), (F.col("before") < F.col("first")).alias("later")))


def candidate_pairs(classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes, a the smaller set, that pass the prefix, length, positional and bitmap filters and have
    no common hub."""
    # A larger class shares a prefix word with those of a smaller one's that keep the overlap of two classes of its size.
    reach = F.when((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n"), F.floor(F.col("n") * 100 / percent)).otherwise(F.col("n"))
    octaves = F.sequence(F.floor(F.log2("n")).cast("int"), F.floor(F.log2(reach)).cast("int"))
    hubs = members.select("cid", "hub")
    prefixes = (attached(classes, hubs, "cid").select("cid", "n", "low", "high", "hub", F.posexplode("prefix").alias("at", "of"))
                .withColumn("octave", F.explode(octaves))
                .select("cid", "low", "high", "hub", "n", "at", (F.floor(F.log2("n")) < F.col("octave")).alias("extra"), F.hash("of", "octave").alias("word")))
    # Both sides are the same plan, so that Spark shuffles the prefixes once and reads them twice.
    x, y = prefixes.alias("x"), prefixes.alias("y")
    both = F.col("x.n") + F.col("y.n")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
    apart = F.coalesce(F.col("x.hub") != F.col("y.hub"), F.lit(True))
    own = ~(F.col("x.extra") & F.col("y.extra"))  # else they meet in their own octave
    overlap = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    may = ((100 * F.col("x.n") >= percent * F.col("y.n")) & ((100 + percent) * overlap >= percent * both)
           & ((100 + percent) * bits_apart("x", "y") <= (100 - percent) * both))
    joined = x.join(y, (F.col("x.word") == F.col("y.word")) & smaller & own & apart & may)
    return joined.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole word sets reach the similarity."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")), lines)
    whole = (pairs.join(sets.alias("x"), F.col("a") == F.col("x.cid")).select("a", "b", F.col("x.set").alias("x_set"))
             .join(sets.alias("y"), F.col("b") == F.col("y.cid")))
    shared = F.size(F.array_intersect("x_set", F.col("y.set")))
    return whole.filter((100 + percent) * shared >= percent * (F.size("x_set") + F.size(F.col("y.set")))).select("a", "b")


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per line with words: row, id, line, bytes, class (of its word set), links (of its class to other
    classes), removed."""
    lines = stored(with_set(split_lines(numbered(docs, id_col, text_col))), "lines", **COMPACT)
    classes = stored(word_classes(lines, rarity_levels(lines), percent), "classes")
    members = hub_members(classes, lines, percent)
    pairs = stored(candidate_pairs(classes, members, percent), "pairs")
    links = stored(verified(pairs, lines, percent).union(hub_links(members, percent)), "links")

    touched = stored(members.select("cid").union(links.select(F.explode(F.array("a", "b")))), "touched")
    firsts = wanted_rows(classes.select("cid", "first"), touched, "cid")
    ends = (links.join(firsts.select(F.col("cid").alias("a"), F.col("first").alias("f")), "a")
            .join(firsts.select(F.col("cid").alias("b"), F.col("first").alias("g")), "b")
            .select(F.explode(F.array(F.struct(F.col("a").alias("cid"), (F.col("g") < F.col("f")).alias("later")),
                                      F.struct(F.col("b").alias("cid"), (F.col("f") < F.col("g")).alias("later")))).alias("e")))
    each = ends.select("e.cid", F.lit(1).cast("long").alias("links"), "e.later").union(certain_links(members, firsts))
    marks = stored(each.groupBy("cid").agg(F.sum("links").alias("links"), F.max("later").alias("later")), "marks")
    # Classes of one line without links need no join: the line has no links and stays.
    about = stored(attached(classes.select("cid", "key", "first", "copies"), marks, "cid").filter("copies > 1 OR links IS NOT NULL")
                   .select("key", "first", "links", "later"), "about")
    slim = attached(lines.select("row", "id", "hash", "line", "bytes", "key"), about, "key")
    copy = F.col("first").isNotNull() & ~place().eqNullSafe(F.col("first"))
    return slim.select("row", "id", "line", "bytes", F.col("key").alias("class"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
                       (F.coalesce("later", F.lit(False)) | copy).alias("removed"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, text: the texts without their removed lines."""
    gone = near_duplicate_lines(docs, id_col, text_col).filter("removed").groupBy("row").agg(F.collect_set("line").alias("gone"))
    kept = F.expr("array_join(filter(split(text, '\\n'), (l, i) -> NOT array_contains(gone, i)), '\n')")
    return (numbered(docs, id_col, text_col).join(gone, "row", "left")
            .select("row", "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text")))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicate_lines(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "line", "bytes", F.col("class").alias("class_id"), "links", "removed")
