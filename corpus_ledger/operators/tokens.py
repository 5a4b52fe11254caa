"""Tokenizer operators T1-T16: pre-tokenisation, vocabulary, BPE merges, encode/decode, packing.

Corpus-wide work (word and pair counts) is aggregation with map-side combine, so a very frequent
word is reduced before the shuffle. The merge learner takes many merges per round over the distributed
distinct-word table. Applying merges is the one Python step: an Arrow UDF over the tokens of a batch, which stay in
Arrow; only the distinct ones of some ten thousand at a time become Python strings, so memory does not grow with
the rows of a task. The merge list it needs is bounded by the merge budget.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_ledger.functions.joins import broadcast_bounded
from corpus_ledger.functions.ranks import bounded_row_number
from corpus_ledger.functions.text import (BOS_ID, EOS_ID, LEADING_WS, PAD_ID, SPECIALS, STRIP, UNK, UNK_ID, WS,
                                          characters, pretokenize)
from corpus_ledger.functions.materialize import materialize
from corpus_ledger.session import checkpoint_dir

# Fixed value: merges reserved out of the vocabulary budget.
RESERVED_MERGES = 5000
# Distinct words whose pieces / ids a UDF task keeps cached before starting over (bounds memory), and the longest of them.
WORD_CACHE_SIZE = 50_000
SHORT_CHARACTERS = 32
# Tokens of which a UDF holds the distinct ones, or the pieces, as Python objects at a time.
CHUNK_TOKENS = 100_000


# --------------------------------------------------------------------------- T1 - T4
def pre_tokens(df: DataFrame, text_col: str = "text", strip: bool = True, out: str = "tokens") -> DataFrame:
    """Add the pre-token array of each text."""
    return df.withColumn(out, pretokenize(F.col(text_col), strip))


def word_frequencies(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus frequency of every unstripped pre-token."""
    return texts.select(F.explode(pretokenize(F.col(text_col), strip=False)).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def specials_frame(spark) -> DataFrame:
    return spark.createDataFrame(SPECIALS, "token string, id long")


def initial_vocab(freqs: DataFrame, vocab_size: int = 10000, min_frequency: int = 2,
                  reserved_merges: int = RESERVED_MERGES) -> DataFrame:
    """The four special tokens, then tokens by count (desc, ties by token, D9) with count >=
    min_frequency until the vocabulary holds vocab_size - reserved_merges entries."""
    spark = freqs.sparkSession
    room = vocab_size - reserved_merges - len(SPECIALS)
    specials = specials_frame(spark)
    if room <= 0:
        return specials
    order = [F.desc("count"), F.col("token")]
    top = freqs.filter(F.col("count") >= min_frequency).orderBy(*order).limit(room)
    ranked = bounded_row_number(top, order, "rn")  # at most ``room`` rows
    return specials.unionByName(ranked.select("token", (F.col("rn") + len(SPECIALS) - 1).cast("long").alias("id")))


def word_table(freqs: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Distinct words kept for merge learning, split into code points."""
    return freqs.filter(F.col("count") >= min_frequency).select(
        F.col("token").alias("word"), characters(F.col("token")).alias("pieces"), F.col("count").alias("freq"))


def adjacent_pairs(pieces: Column) -> Column:
    n = F.size(pieces)
    return F.zip_with(F.slice(pieces, 1, n - 1), F.slice(pieces, 2, n - 1),
                      lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def pair_counts(words: DataFrame) -> DataFrame:
    """T4: adjacent piece pairs weighted by word frequency."""
    return words.filter(F.size("pieces") > 1) \
        .select(F.explode(adjacent_pairs(F.col("pieces"))).alias("p"), "freq") \
        .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")) \
        .agg(F.sum("freq").alias("count"))


# --------------------------------------------------------------------------- T5, T6
def accept_merges(cands: list[tuple[str, str, int]], created: set[str]) -> list[tuple[str, str]]:
    """The prefix of the ranked candidate pairs that sequential merging would pick next, in order.

    ``cands`` are the top pairs (left, right, count) in rank order (count desc, then pair). The first
    is always taken. A later candidate p_j is taken while
    (a) every earlier taken pair has distinct symbols (left != right), shares no symbol with it, and
        neither it nor they produce a token that already exists (``created``) or is a symbol of another;
    (b) its count is strictly above the next candidate's.
    Then merging p_1..p_(j-1) leaves p_j's count unchanged, lowers or keeps the counts of pairs
    touching their symbols, and every pair that gains (one touching a new token t = a + b) is bounded
    by an old pair count (x, a) or (b, y) below p_j's, so p_j is the best pair at step j exactly.
    """
    a, b, _ = cands[0]
    taken = [(a, b)]
    used = {a, b, a + b}
    if a == b or (a + b) in created:
        return taken
    for j in range(1, len(cands) - 1):
        c, d, n = cands[j]
        if n <= cands[j + 1][2] or c == d:
            break
        t = c + d
        if c in used or d in used or t in used or t in created:
            break
        taken.append((c, d))
        used |= {c, d, t}
    return taken


def _merged(pieces: list[str], left: str, right: str) -> list[str]:
    """Non-overlapping occurrences of (left, right) joined, from left to right."""
    out: list[str] = []
    for piece in pieces:
        if out and piece == right and out[-1] == left:
            out[-1] = left + right
        else:
            out.append(piece)
    return out


def merge_segments(segments: list[tuple[list[str], int]], least: int, limit: int) -> list[tuple[str, str]]:
    """The next merges of the whole corpus, up to ``limit``, as far as its heavy segments tell them: the words cut
    between the pieces of every pair that occurs fewer than ``least`` times.

    Merging all occurrences of a pair treats equal strings alike wherever no merge crosses their ends, so a token
    comes about in one way only: it begins with one certain piece of before, and ends with one. A pair that arises
    therefore stands only where its last and its first piece of before met, and is no more frequent than they were
    together. So every pair of ``least`` or more occurrences lies inside the segments at any later time, counted in
    full; merging goes on while the best pair has as many, and the result is that of merging whole words.
    """
    segments = list(segments)
    counts: Counter = Counter()
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (pieces, freq) in enumerate(segments):
        for pair in zip(pieces, pieces[1:]):
            counts[pair] += freq
            holders[pair].add(i)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(merges) < limit:
        n, left, right = heappop(heap)
        if counts[left, right] != -n or not n:
            continue  # an older count of the pair
        if -n < least:
            break
        merges.append((left, right))
        changed = set()
        for i in holders.pop((left, right)):
            pieces, freq = segments[i]
            merged = _merged(pieces, left, right)
            for pair in zip(pieces, pieces[1:]):
                counts[pair] -= freq
                changed.add(pair)
            for pair in zip(merged, merged[1:]):
                counts[pair] += freq
                holders[pair].add(i)
                changed.add(pair)
            segments[i] = (merged, freq)
        for pair in changed:
            if counts[pair] > 0:
                heappush(heap, (-counts[pair], *pair))
    return merges


def _rewrite_short(pieces: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    none = 1 << 62
    waiting = [ranks.get(pair, none) for pair in zip(pieces, pieces[1:])]
    if not waiting or min(waiting) == none:
        return pieces
    pieces = list(pieces)
    while waiting and (best := min(waiting)) < none:
        i = waiting.index(best)
        pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
        del waiting[i]
        if i:
            waiting[i - 1] = ranks.get((pieces[i - 1], pieces[i]), none)
        if i < len(waiting):
            waiting[i] = ranks.get((pieces[i], pieces[i + 1]), none)
    return pieces


def rewrite(pieces: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The pieces after the merges of ``ranks``, one after the other. Pairs to merge wait in a heap by rank and
    position, so a list of n pieces takes n log n steps; a short list is looked through instead."""
    n = len(pieces)
    if n <= SHORT_CHARACTERS:
        return _rewrite_short(pieces, ranks)
    if not any(pair in ranks for pair in zip(pieces, pieces[1:])):
        return pieces
    piece, after, before = list(pieces), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def wait(i: int) -> None:
        if i >= 0 and after[i] < n:
            pair = (piece[i], piece[after[i]])
            if pair in ranks:
                heappush(heap, (ranks[pair], i, *pair))

    for i in range(n - 1):
        wait(i)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if piece[i] != left or j >= n or piece[j] != right:
            continue
        piece[i], piece[j], after[i] = left + right, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        wait(i)
        wait(before[i])
    return [x for x in piece if x is not None]


def _segments(words: DataFrame, heavy: set[tuple[str, str]]) -> DataFrame:
    """(pieces, freq) of the distinct segments that are left when words are cut between the pieces of all
    pairs that are not ``heavy``; single pieces are left out."""
    sent = words.sparkSession.sparkContext.broadcast(heavy)

    def cut(batches):
        heavy = sent.value
        for batch in batches:
            found: Counter = Counter()
            for pieces, freq in zip(batch.column("pieces").to_pylist(), batch.column("freq").to_pylist()):
                start = 0
                for i in range(1, len(pieces) + 1):
                    if i == len(pieces) or (pieces[i - 1], pieces[i]) not in heavy:
                        if i - start > 1:
                            found[tuple(pieces[start:i])] += freq
                        start = i
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, found)), pa.list_(pa.string())),
                                              pa.array(list(found.values()), pa.int64())], ["pieces", "freq"])

    return words.mapInArrow(cut, "pieces array<string>, freq long").groupBy("pieces").agg(F.sum("freq").alias("freq"))


def _rewritten(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """The words after ``merges``; words of one piece have no pair and leave."""
    sent = words.sparkSession.sparkContext.broadcast({pair: i for i, pair in enumerate(merges)})

    def apply(batches):
        ranks = sent.value
        for batch in batches:
            pieces = [rewrite(p, ranks) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.list_(pa.string())), batch.column("freq")],
                                             ["pieces", "freq"])

    return words.mapInArrow(apply, "pieces array<string>, freq long").filter(F.size("pieces") > 1)


def learn_merges(words: DataFrame, num_merges: int, max_segments: int = 30_000, max_pairs: int = 4096,
                 first_pairs: int = 64) -> DataFrame:
    """T5: learn ``num_merges`` merges; the most frequent pair (ties by pair, D9) is merged and the
    words rewritten, exactly as a sequential loop would.

    The word table stays distributed. A round counts all pairs, takes the heaviest of them, and cuts every word
    between the pieces of all others; what is left are few distinct segments, aggregated over the corpus.
    ``merge_segments`` learns from them as many merges as they determine, often hundreds, and the words are
    rewritten in place. Both that reach the driver are bounded by the parameters, whatever the corpus: the
    ``max_pairs`` heaviest pairs, of which fewer are taken when they leave more than ``max_segments`` segments.
    If more than ``max_pairs`` pairs share the highest count, or even the fewest heavy pairs leave too many
    segments, ``accept_merges`` takes the merges that the counts alone determine, the best pair at least. Every
    round ends with a reliable checkpoint of the words.

    Returns (rank, left, right).
    """
    spark = words.sparkSession
    # The distinct-word table is small after aggregation and AQE may coalesce it into one partition;
    # spread it over the cluster's task slots so each round's scan runs in parallel.
    w = materialize(words.select("pieces", F.col("freq").cast("long").alias("freq")).filter(F.size("pieces") > 1)
                    .repartition(spark.sparkContext.defaultParallelism))
    merges: list[tuple[str, str]] = []
    created: set[str] = set()
    wanted = first_pairs
    while len(merges) < num_merges:
        wanted = max(wanted, 1)
        top = [(r["left"], r["right"], int(r["count"])) for r in
               pair_counts(w).orderBy(F.desc("count"), "left", "right").limit(max_pairs + 1).collect()]
        if not top:
            break
        picked: list[tuple[str, str]] = []
        while not picked:
            whole = len(top) <= min(wanted, max_pairs)
            least = 1 if whole else top[min(wanted, max_pairs)][2] + 1
            heavy = {(a, b) for a, b, n in top if n >= least}
            if not heavy:
                # After the last pair nothing follows, or the pair beyond the limit.
                ranked = top if len(top) > max_pairs else top + [("", "", -1)]
                picked = accept_merges(ranked, created)[: num_merges - len(merges)]
                break
            cut = _segments(w, heavy).persist()
            size = cut.count()
            if size <= max_segments:
                picked = merge_segments([(r["pieces"], r["freq"]) for r in cut.collect()], least,
                                        num_merges - len(merges))
                if size <= max_segments // 3:
                    wanted = min(wanted * 2, max_pairs)
            else:
                wanted //= 2
            cut.unpersist()
        merges += picked
        created |= {a + b for a, b in picked}
        if len(merges) < num_merges:
            w = materialize(_rewritten(w, picked))
    return spark.createDataFrame([(i, *pair) for i, pair in enumerate(merges, 1)], "rank int, left string, right string")


def extend_vocab(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged tokens not yet in the vocabulary, appended in merge order."""
    merged = merges.select(F.concat("left", "right").alias("token"), "rank") \
        .groupBy("token").agg(F.min("rank").alias("rank"))
    new = merged.join(vocab.select("token"), "token", "left_anti")
    base = vocab.agg(F.max("id")).first()[0]
    base = -1 if base is None else int(base)
    ranked = bounded_row_number(new, ["rank"], "rn")  # bounded by the merge count
    return vocab.unionByName(ranked.select("token", (F.col("rn") + base).cast("long").alias("id")))


def train_tokenizer(texts: DataFrame, vocab_size: int = 10000, min_frequency: int = 2,
                    num_merges: int | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, merges). ``num_merges`` defaults to the reference's budget
    min(reserved, vocab_size - len(initial vocabulary))."""
    freqs = materialize(word_frequencies(texts, text_col))  # read twice; the texts once
    return train_from_counts(freqs, vocab_size, min_frequency, num_merges)


def train_from_counts(freqs: DataFrame, vocab_size: int = 10000, min_frequency: int = 2,
                      num_merges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """T3-T6 over stored word counts (T2): (vocabulary, merges)."""
    vocab = materialize(initial_vocab(freqs, vocab_size, min_frequency))
    if num_merges is None:
        num_merges = min(RESERVED_MERGES, vocab_size - vocab.count())
    merges = learn_merges(word_table(freqs, min_frequency), max(num_merges, 0))
    return extend_vocab(vocab, merges), merges


# --------------------------------------------------------------------------- T7, T8
def merge_pairs(merges: DataFrame) -> list[tuple[str, str]]:
    """The merge list as (left, right) pairs. Its size is the tokenizer's merge budget, whatever the
    corpus, so it is shipped to the tasks as a broadcast variable."""
    return [(r["left"], r["right"]) for r in merges.select("left", "right").collect()]


def _bpe(word: str, merge_set: frozenset) -> list[str]:
    """Leftmost adjacent pair that is a known merge (D6), repeated. Nothing before the pair left of a
    merge can have become a known pair, so pieces are stacked and each is merged into the top while it can be."""
    out: list[str] = []
    for piece in word:
        out.append(piece)
        while len(out) > 1 and (out[-2], out[-1]) in merge_set:
            right = out.pop()
            out[-1] += right
    return out


def _bpe_dropout(word: str, merge_set: frozenset, p: float, stream: str) -> list[str]:
    """BPE-dropout: in each step every known pair is skipped with probability ``p``; the first pair left
    over is merged at its first occurrence. The draw of a position is a hash of (stream, step, position).

    Known pairs wait in a heap by the place of their first character, and a tree of counts gives the position
    among the pieces that are left, so a step looks at the pairs it skips and not at the whole token."""
    n = len(word)
    if n <= SHORT_CHARACTERS:
        return _bpe_dropout_short(word, merge_set, math.ceil(p * 2.0 ** 64), stream)
    piece, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
    counts = [i & -i for i in range(n + 1)]  # binary indexed tree of ones
    heap, waiting = [], [False] * n

    def position(i: int) -> int:
        total = 0
        while i:
            total += counts[i]
            i &= i - 1
        return total

    def pair_at(i: int) -> tuple[str, str] | None:
        if piece[i] is None or after[i] >= n:
            return None
        pair = (piece[i], piece[after[i]])
        return pair if pair in merge_set else None

    def wait(i: int) -> None:
        if i >= 0 and not waiting[i] and pair_at(i):
            waiting[i] = True
            heappush(heap, i)

    for i in range(n - 1):
        wait(i)
    step = 0
    while True:
        seen: list[int] = []
        pair = None
        while heap and pair is None:
            i = heappop(heap)
            known = pair_at(i)
            if known is None:  # a neighbour has changed meanwhile
                waiting[i] = False
                continue
            seen.append(i)
            if xxhash.xxh3_64_intdigest(f"{stream}|{step}|{position(i)}") >= p * 2.0 ** 64:
                pair = known
        if pair is None:
            return [x for x in piece if x is not None]
        at = next(i for i in seen if pair_at(i) == pair)
        for i in seen:
            if i != at:
                heappush(heap, i)
        waiting[at] = False
        j = after[at]
        piece[at], piece[j], after[at] = piece[at] + piece[j], None, after[j]
        if after[j] < n:
            before[after[j]] = at
        i = j + 1
        while i <= n:
            counts[i] -= 1
            i += i & -i
        wait(at)
        wait(before[at])
        step += 1


def _bpe_dropout_short(word: str, merge_set: frozenset, least: int, stream: str) -> list[str]:
    """``_bpe_dropout`` of a short token on plain lists, where a draw below ``least`` skips a pair: looking at all its
    places in each step costs less than a heap."""
    pieces = list(word)
    known = [pair in merge_set for pair in zip(word, word[1:])]
    step = 0
    while True:
        for i, is_known in enumerate(known):
            if is_known and xxhash.xxh3_64_intdigest(f"{stream}|{step}|{i}") >= least:
                break
        else:
            return pieces
        left, right = pieces[i], pieces[i + 1]
        if True in known[:i]:  # a skipped pair may be the same
            i = next(k for k in range(i + 1) if pieces[k] == left and pieces[k + 1] == right)
        pieces[i:i + 2] = [left + right]
        del known[i]
        if i:
            known[i - 1] = (pieces[i - 1], pieces[i]) in merge_set
        if i < len(known):
            known[i] = (pieces[i], pieces[i + 1]) in merge_set
        step += 1


def _remembered(pieces_of: Callable[[str], list]) -> Callable[[str], list]:
    """``pieces_of`` with its results for short words kept for the life of the task, up to ``WORD_CACHE_SIZE``."""
    cache: dict[str, list] = {}

    def of(word: str) -> list:
        got = cache.get(word)
        if got is None:
            got = pieces_of(word)
            if len(word) <= SHORT_CHARACTERS:
                if len(cache) >= WORD_CACHE_SIZE:
                    cache.clear()
                cache[word] = got
        return got

    return of


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Number of items up to the end of each row; a null row has none."""
    return np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def _rows(ends: np.ndarray, items: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    """Rows of ``items`` that end at ``ends``; where ``null`` the row is null."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, items, mask=None if null is None else pa.array(null))


def _parts(items: pa.Array) -> list[pa.Array]:
    return [items.slice(start, CHUNK_TOKENS) for start in range(0, len(items), CHUNK_TOKENS)]


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _flat_map(tokens: pa.ListArray, pieces_of: Callable[[str], list], kind: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    """``pieces_of`` every token, flattened: (end of each row, items). Each distinct token of a chunk is taken once."""
    lengths, parts = [np.zeros(1, np.int64)], []
    for part in _parts(tokens.flatten()):
        coded = part.dictionary_encode()
        found = [pieces_of(word) for word in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        firsts = np.cumsum(sizes) - sizes
        items = pa.array([x for pieces in found for x in pieces], kind)
        word = coded.indices.to_numpy(zero_copy_only=False)
        length = sizes[word]
        before = np.cumsum(length) - length
        parts.append(items.take(pa.array(np.repeat(firsts[word] - before, length) + np.arange(length.sum()))))
        lengths.append(length)
    ends = np.cumsum(np.concatenate(lengths))  # of each token, after a leading 0
    return ends[_ends(tokens)], _joined(parts, kind)


def apply_merges(df: DataFrame, merges: DataFrame, tokens_col: str = "tokens", out: str = "pieces") -> DataFrame:
    """BPE pieces of every (stripped) pre-token, flattened per row.

    The merge list is bounded by the merge budget and shipped to the tasks as a broadcast variable.
    """
    bc = df.sparkSession.sparkContext.broadcast(frozenset(merge_pairs(merges)))
    pieces_of = _remembered(lambda word: _bpe(word, bc.value))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def bpe(tokens: pa.Array) -> pa.Array:
        return _rows(*_flat_map(tokens, pieces_of, pa.string()), tokens.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn(out, bpe(F.col(tokens_col)))


def apply_merges_dropout(df: DataFrame, merges: DataFrame, key_col: str, p: float = 0.1, seed: int = 0,
                         tokens_col: str = "tokens", out: str = "pieces") -> DataFrame:
    """BPE-dropout: each candidate merge is skipped with probability ``p``. The draws are hashes of
    (seed, row key as text, token position, step, pair position), so a retried task repeats its result."""
    bc = df.sparkSession.sparkContext.broadcast(frozenset(merge_pairs(merges)))
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def bpe_drop(keys: pa.Array, tokens: pa.Array) -> pa.Array:
        ms, values, starts = bc.value, tokens.flatten(), [0, *_ends(tokens).tolist()]
        ends, parts, pieces, done = [], [], [], 0
        for k, start, stop in zip(keys.to_pylist(), starts, starts[1:]):
            for first in range(start, stop, CHUNK_TOKENS):
                words = values.slice(first, min(CHUNK_TOKENS, stop - first)).to_numpy(zero_copy_only=False).tolist()
                for i, word in enumerate(words, first - start):
                    pieces += _bpe_dropout(word, ms, p, f"{seed}|{k}|{i}")
                if len(pieces) >= CHUNK_TOKENS:
                    parts.append(pa.array(pieces, pa.string()))
                    done += len(pieces)
                    pieces = []
            ends.append(done + len(pieces))
        parts.append(pa.array(pieces, pa.string()))
        return _rows(np.array(ends, np.int64), pa.concat_arrays(parts), tokens.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn(out, bpe_drop(F.col(key_col), F.col(tokens_col)))


# --------------------------------------------------------------------------- T9 - T15
def tokens_to_ids(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, out: str = "ids",
                  max_tokens: int | None = None, max_vocab: int = 1 << 20) -> DataFrame:
    """Token -> id (unknown -> 3), order kept; optionally only the first ``max_tokens``.

    The vocabulary is bounded by the tokenizer's size and broadcast after a size check.
    """
    # Of a plain column Spark would infer a filter on its size, which computes the tokens a second time.
    tokens = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    ex = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    if max_tokens is not None:
        ex = ex.filter(F.col("pos") < max_tokens)
    v = broadcast_bounded(vocab.select("token", F.col("id").alias("tid")), max_vocab)
    j = ex.join(v, "token", "left").select(key, "pos", F.coalesce("tid", F.lit(UNK_ID)).alias("tid"))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tid"))).alias("_a"))
    g = g.select(key, F.transform("_a", lambda s: s["tid"]).alias(out))
    return df.join(g, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<long>")))


def lookup_ids(df: DataFrame, tokens_col: str, vocab: DataFrame, out: str = "ids", merges: DataFrame | None = None,
               max_tokens: int | None = None, max_vocab: int = 1 << 20) -> DataFrame:
    """T7 + T9 without a shuffle: per row, optional BPE then token -> id (unknown -> 3), optionally
    only the first ``max_tokens``.

    The vocabulary (bounded by the tokenizer size, checked) and the merge list (bounded by the merge
    budget) are broadcast variables. This avoids exploding every token and regrouping it by row, which would
    shuffle the whole corpus.
    """
    known = _entries(vocab, max_vocab)
    if known is None:
        raise ValueError(f"vocabulary larger than {max_vocab}")
    return _looked_up(df, tokens_col, known, out, merges, max_tokens)


def _looked_up(df: DataFrame, tokens_col: str, known: list[tuple[str, int]], out: str, merges: DataFrame | None,
               max_tokens: int | None) -> DataFrame:
    sc = df.sparkSession.sparkContext
    bv = sc.broadcast(dict(known))
    bm = sc.broadcast(None if merges is None else frozenset(merge_pairs(merges)))
    pieces_of = _remembered(lambda word: [bv.value.get(piece, UNK_ID) for piece in _bpe(word, bm.value)])

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def to_ids(tokens: pa.Array) -> pa.Array:
        if bm.value is None:
            words, numbers = pa.array(list(bv.value), pa.string()), pa.array(list(bv.value.values()), pa.int64())
            parts = [pc.fill_null(numbers.take(pc.index_in(part, words)), UNK_ID) for part in _parts(tokens.flatten())]
            ends, ids = _ends(tokens), _joined(parts, pa.int64())
        else:  # with no merges at all: code points
            ends, ids = _flat_map(tokens, pieces_of, pa.int64())
        if max_tokens is None:
            return _rows(ends, ids)
        sizes = np.diff(ends, prepend=0)
        parts = [ids.slice(end - n, min(n, max_tokens)) for end, n in zip(ends.tolist(), sizes.tolist())]
        return _rows(np.cumsum(np.minimum(sizes, max_tokens)), _joined(parts, pa.int64()))

    return df.withColumn(out, to_ids(F.col(tokens_col)))


def _entries(vocab: DataFrame, max_vocab: int = 1 << 20) -> list[tuple[str, int]] | None:
    """The vocabulary, computed once, when it is small enough for a lookup inside the tasks; a larger one (None) is
    joined."""
    rows = vocab.select("token", "id").limit(max_vocab + 1).collect()
    return [(r["token"], int(r["id"])) for r in rows] if len(rows) <= max_vocab else None


def ids_to_tokens(vocab: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """T9 (inverse): id -> token, unknown ids -> [UNK]."""
    v = vocab.select(F.col("id").alias(id_col), "token")
    return ids.join(v, id_col, "left").withColumn("token", F.coalesce("token", F.lit(UNK)))


def encode(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, max_length: int | None = None,
           truncation: bool = True, add_eos: bool = True, out: str = "input_ids", method: str = "lookup",
           merges: DataFrame | None = None) -> DataFrame:
    """Ids of the tokens (after BPE when ``merges`` is given), truncated to max_length - 1, then
    EOS appended. ``method='join'`` uses the JVM-only explode / broadcast-join / regroup path."""
    keep = max_length - 1 if (truncation and max_length) else None
    known = None if method == "join" else _entries(vocab)
    if known is None:
        src = df if merges is None else apply_merges(df, merges, tokens_col, tokens_col)
        r = tokens_to_ids(src, key, tokens_col, vocab, out, max_tokens=keep)
    else:
        r = _looked_up(df, tokens_col, known, out, merges, keep)
    if add_eos:
        r = r.withColumn(out, F.array_append(F.col(out), F.lit(EOS_ID).cast("long")))
    return r


def _clean_spaces(text):
    """Strip, then collapse whitespace runs to one space (Python's whitespace, JVM-side)."""
    return F.regexp_replace(F.regexp_replace(text, f"{LEADING_WS}|[{STRIP}]+$", ""), f"[{WS}]+", " ")


def decode(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, skip_special_tokens: bool = True,
           clean_up: bool = True, out: str = "text", max_vocab: int = 1 << 20, method: str = "lookup") -> DataFrame:
    """Drop pad/eos/bos, map ids to tokens, join with spaces, strip and collapse whitespace.

    ``method='lookup'`` maps ids inside each row through the bounded vocabulary (a broadcast
    variable, size checked), with no shuffle; ``method='join'`` explodes, broadcast-joins and
    regroups by row.
    """
    known = _entries(vocab, max_vocab) if method == "lookup" else None
    if known is not None:
        bv = df.sparkSession.sparkContext.broadcast({i: token for token, i in known})
        skip = [PAD_ID, EOS_ID, BOS_ID] if skip_special_tokens else []

        @F.arrow_udf(T.StringType())
        def to_text(ids: pa.Array) -> pa.Array:
            numbers, words = pa.array(list(bv.value), pa.int64()), pa.array(list(bv.value.values()), pa.string())
            ends, rows, first = _ends(ids), [], 0
            while first < len(ids):  # rows of a chunk of tokens, one at least
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_TOKENS, "right")))
                part = ids.slice(first, last - first)
                flat = part.flatten().cast(pa.int64())
                kept = pc.invert(pc.is_in(flat, pa.array(skip, pa.int64())))
                upto = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int64)])
                tokens = pc.fill_null(words.take(pc.index_in(flat.filter(kept), numbers)), UNK)
                null = part.is_null().to_numpy(zero_copy_only=False)
                rows.append(pc.binary_join(_rows(upto[ends[first:last] - done], tokens, null), " "))
                first = last
            return _joined(rows, pa.string())

        text = to_text(F.col(ids_col))
        return df.withColumn(out, F.coalesce(_clean_spaces(text) if clean_up else text, F.lit("")))
    ex = df.select(key, F.posexplode(ids_col).alias("pos", "tid"))
    if skip_special_tokens:
        ex = ex.filter(~F.col("tid").isin(PAD_ID, EOS_ID, BOS_ID))
    v = broadcast_bounded(vocab.select(F.col("id").alias("tid"), "token"), max_vocab)
    j = ex.join(v, "tid", "left").select(key, "pos", F.coalesce("token", F.lit(UNK)).alias("token"))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_a"))
    text = F.array_join(F.transform("_a", lambda s: s["token"]), " ")
    if clean_up:
        text = _clean_spaces(text)
    g = g.select(key, text.alias(out))
    return df.join(g, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def special_tokens_mask(ids: Column, already_has_special_tokens: bool = True, pair: Column | None = None) -> Column:
    """1 for pad/eos/bos ids (already has specials), else zeros plus a 1 for the EOS that packing
    appends, after each of the two sequences when there is a ``pair``."""
    if already_has_special_tokens:  # one sequence that holds both parts
        return F.transform(ids, lambda x: F.when(x.isin(PAD_ID, EOS_ID, BOS_ID), 1).otherwise(0))
    masks = [F.concat(F.array_repeat(F.lit(0), F.size(part)), F.array(F.lit(1))) for part in (ids, pair) if part is not None]
    return F.concat(*masks)


def pack_pair(a: Column, b: Column | None = None) -> tuple[Column, Column]:
    """A + EOS (+ b + EOS) and the matching 0/1 type ids."""
    eos = F.array(F.lit(EOS_ID).cast("long"))
    if b is None:
        return F.concat(a, eos), F.array_repeat(F.lit(0), F.size(a) + 1)
    return (F.concat(a, eos, b, eos),
            F.concat(F.array_repeat(F.lit(0), F.size(a) + 1), F.array_repeat(F.lit(1), F.size(b) + 1)))


def pad_batches(df: DataFrame, batch_col: str, ids_col: str = "input_ids") -> DataFrame:
    """Pad each sequence to the longest of its batch with PAD, plus the attention mask.

    A batch holds a handful of sequences (the batch size), so the batch window is small.
    """
    w = Window.partitionBy(batch_col)
    n = F.size(ids_col)
    longest = F.max(n).over(w)
    return df.withColumn("_max", longest).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_max") - n))
    ).withColumn(ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(PAD_ID).cast("long"), F.col("_max") - n))) \
     .drop("_max")


def added_vocab(vocab: DataFrame) -> DataFrame:
    """Vocabulary entries other than the four specials."""
    sp = specials_frame(vocab.sparkSession)
    return vocab.join(F.broadcast(sp), ["token", "id"], "left_anti")
