"""Toxicity by a lexicon whose misspellings are found with Levenshtein automata.

1. Lexicon: over a bounded sample of labelled documents, Spark counts for each word and each word prefix
   in how many toxic and clean documents it occurs. Entries whose share among toxic documents is high
   beyond chance enter the lexicon, a prefix as a stem (it then stands for every word that begins with it).
2. Matching: the lexicon is a trie, and a Levenshtein automaton is run over all its words at once: a state
   is the set of (trie node, edits) reached, remembered per letter, so a word that cannot match ends after a
   few letters. Short entries allow no edits, long ones two; two swapped letters count as one edit. A run of
   letters with digits, underscores or symbols among them ('idi0t') is matched whole, unless one of its
   letter parts is an entry itself.
3. Context: each match looks at the words around it. Quotation marks and words of speech or mention around
   it speak for quotation; marks of address and further matches nearby speak for abuse. A match with edits
   counts as an exact one does, but less with each edit.
4. A logistic model over the document's match statistics gives the score. Its rows use a lexicon learned
   from the other half of the sample, so it sees matches as they are on unseen text.

Defined results: a text without matches, null and empty text included, gets the model's base score; null
and repeated doc_ids are scored row by row; without labelled rows, or with one class only, every score is
that class's share (0 without any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import documents, stored

SAMPLE_ROWS = 20_000  # documented bound: labelled documents used to learn
LEXICON_SIZE = 2_000
EDIT_LENGTH = 5       # entries shorter than this must match exactly
LONG_LENGTH = 8       # entries from this length on allow two edits, those between allow one
EDIT_SHARE = 0.5      # what a match counts for context, per edit
STEM_LENGTHS = (4, 5, 6, 7)
MIN_TOXIC = 3
MIN_EVIDENCE = 24.0   # log-likelihood ratio that an entry needs: thousands of entries are tried
MIN_PURITY = 0.8      # share of toxic documents among those with the entry
WINDOW = 6            # words on either side of a match
CACHED = 300_000
FEATURES = 7

_WORD = re.compile(r"[^\W\d_]+|[\"“”«»'‘’!?]")
# A run of word characters and symbols that is more than letters; from its start only.
_MIXED = re.compile(r"(?<![\w@$*#+|!'’.\-])[^\W\d_]*+(?:[\d_@$*#+|]|[!'’.\-](?=[\w@$]))[\w@$*#+|!'’.\-]*+")
# Marks and words of quotation, mention and address.
QUOTES = frozenset("\"“”«»‘’")
SPEECH = frozenset("said says say wrote word term called quote quoted quotes means sagte wort dit mot dijo palabra".split())
ADDRESS = frozenset("you your youre u du dich dein ihr tu te vous toi tú usted ! ?".split())


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Is crc32 of the id as text, modulo ``parts``, equal to ``part``? (null id: as the empty text)"""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """text, label, half of about ``limit`` labelled documents, chosen by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", label)
    share = min(1.0, limit / max(1, known.count()))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(unit < share).select(F.col("doc_id").alias("_doc"), F.col(label).cast("int").alias("label"))
    if chosen.limit(2 * limit + 1).count() <= 2 * limit:
        chosen = F.broadcast(chosen)
    half = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)).cast("int")
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_doc")).select("text", "label", half.alias("half"))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def mixed_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of the runs of letters with digits, underscores or symbols among them."""
    for found in _MIXED.finditer(text):
        run = found[0].rstrip("!'’.-*#+|")
        end = found.start() + len(run)
        run = run.lstrip("!'’.-*#+|")
        if not run.isalpha() and any(c.isalpha() for c in run):
            yield end - len(run), end, run


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many toxic and clean documents of each half an entry occurs."""
    for batch in batches:
        counts: Counter = Counter()
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
            words = {w for w in words_of(text) if len(w) > 2}
            stems = {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}
            counts.update((entry, half, label) for entry in words | stems)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            + [pa.array(counts.values(), pa.int64())], ["entry", "half", "label", "n"])


def entry_counts(sample: DataFrame) -> DataFrame:
    """entry, half, toxic, clean: numbers of documents, for entries in at least ``MIN_TOXIC`` toxic ones."""
    counted = sample.select("text", "label", "half").mapInArrow(_count_entries, "entry string, half int, label int, n long")
    toxic = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0))
    clean = F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n")))
    each = [f(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for c in ("toxic", "clean") for h in (0, 1) for f in (F.sum,)]
    return (counted.groupBy("entry", "half").agg(toxic.alias("toxic"), clean.alias("clean"))
            .groupBy("entry").agg(*each).filter(F.col("toxic0") + F.col("toxic1") >= MIN_TOXIC)
            .filter(F.col("toxic0") + F.col("toxic1") > F.col("clean0") + F.col("clean1")))


def evidence(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    """Log-likelihood ratio that the entry's rate differs between the classes; 0 if it is not the toxic one's."""
    total = toxic + clean
    expected = total * n_toxic / (n_toxic + n_clean)
    if toxic <= expected:
        return 0.0
    ratio = toxic * math.log(toxic / expected)
    return 2 * (ratio + (clean * math.log(clean / (total - expected)) if clean else 0.0))


def build_lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entry -> weight (log odds); a stem replaces its words, and a longer entry that adds nothing is left out."""
    scored = []
    for entry, toxic, clean in rows:
        g = evidence(toxic, clean, n_toxic, n_clean) if toxic >= MIN_TOXIC else 0.0
        if g >= MIN_EVIDENCE and toxic >= MIN_PURITY * (toxic + clean):
            weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
            scored.append((-g, entry.endswith("*"), -len(entry), entry, weight, toxic))
    lexicon: dict[str, float] = {}
    reach: dict[str, int] = {}
    for *_, entry, weight, toxic in sorted(scored)[:LEXICON_SIZE]:
        stem = entry.rstrip("*")
        if any(stem[:n] + "*" in lexicon for n in STEM_LENGTHS if n <= len(stem)):
            continue
        if entry.endswith("*") and reach.get(stem, 0) >= toxic:
            continue  # all its documents hold one word already taken
        lexicon[entry] = weight
        for n in STEM_LENGTHS:
            reach[stem[:n]] = max(reach.get(stem[:n], 0), toxic)
    return lexicon


class Matcher:
    """Trie of the lexicon, run together with a Levenshtein automaton; transitions are remembered.

    A state holds (node, edits, awaited letter): with ``swaps``, of two letters in exchanged order the second
    one is read first, and the node behind both waits for the other.
    """

    def __init__(self, lexicon: dict[str, float], swaps: bool = False):
        self.swaps = swaps
        self.next: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[str, float]] = {}   # node -> entry that ends there
        self.stem: dict[int, tuple[str, float]] = {}
        self.longest: list[int] = [0]                  # node -> length of the longest entry below
        for entry, weight in sorted(lexicon.items()):
            text, node = entry.rstrip("*"), 0
            for letter in text:
                self.longest[node] = max(self.longest[node], len(text))
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({}), self.longest.append(0)
                node = self.next[node][letter]
            self.longest[node] = max(self.longest[node], len(text))
            (self.stem if entry.endswith("*") else self.word)[node] = (entry, weight)
        self.edits = [self._within(length) for length in self.longest]
        self.seen: dict[str, tuple[str, float, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []    # state -> letter -> state
        self.best: list[tuple] = []              # state -> best stem, best word that end there
        self.empty, self.start = self._numbered(frozenset()), self._numbered(self._close({(0, 0, "")}))

    def _numbered(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state), self.steps.append({})
            self.best.append((self._best(state, self.stem), self._best(state, self.word)))
        return self.number[state]

    @staticmethod
    def _within(length: int) -> int:
        return 0 if length < EDIT_LENGTH else 1 if length < LONG_LENGTH else 2

    def _close(self, state: set) -> frozenset:
        """Add what a missing letter of the text reaches: trie steps that cost one edit each."""
        out, todo = set(state), list(state)
        while todo:
            node, edits, awaited = todo.pop()
            for child in () if awaited else self.next[node].values():
                if edits < self.edits[child] and (child, edits + 1, "") not in out:
                    out.add((child, edits + 1, ""))
                    todo.append((child, edits + 1, ""))
        least: dict[tuple[int, str], int] = {}  # what costs more at the same node is not needed
        for node, edits, awaited in out:
            if edits <= self.edits[node] and edits < least.get((node, awaited), 3):
                least[node, awaited] = edits
        return frozenset((node, edits, awaited) for (node, awaited), edits in least.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        out = set()
        for node, edits, awaited in state:
            if awaited:
                if letter == awaited:
                    out.add((node, edits, ""))
                continue
            child = self.next[node].get(letter)
            if child is not None:
                out.add((child, edits, ""))
            if edits < self.edits[node]:
                out.add((node, edits + 1, ""))                                   # the letter is surplus
                out.update((c, edits + 1, "") for c in self.next[node].values())  # or stands for another
                if self.swaps:                                                   # or came before its neighbour
                    out.update((self.next[c][letter], edits + 1, other) for other, c in self.next[node].items()
                               if other != letter and letter in self.next[c])
        return self._close(out)

    def find(self, word: str) -> tuple[str, float, int] | None:
        """The entry that the word spells with the fewest edits: (entry, weight, edits)."""
        if word in self.seen:
            return self.seen[word]
        best: tuple[int, float, str] | None = None
        if len(self.states) > CACHED // 10:
            self._restart()
        state = self.start
        for letter in word:
            step = self.steps[state].get(letter)
            if step is None:
                step = self.steps[state][letter] = self._numbered(self._step(self.states[state], letter))
            if (state := step) == self.empty:
                break
            stem = self.best[state][0]
            best = stem if best is None or stem is not None and stem < best else best
        else:
            end = self.best[state][1]
            best = end if best is None or end is not None and end < best else best
        if len(self.seen) > CACHED:
            self.seen.clear()
        self.seen[word] = found = (best[2], -best[1], best[0]) if best else None
        return found

    @staticmethod
    def _allowed(entry: str, edits: int) -> bool:
        return edits <= Matcher._within(len(entry.rstrip("*")))

    def _best(self, state: frozenset, ends: dict) -> tuple[int, float, str] | None:
        return min(((edits, -ends[node][1], ends[node][0]) for node, edits, awaited in state
                    if not awaited and node in ends and self._allowed(ends[node][0], edits)), default=None)


def find_all(text: str | None, matcher: Matcher) -> tuple[list[str], list[tuple[int, int, str, float, int]]]:
    """The words of a text, and the matches: (first word, word behind the last, entry, weight, edits)."""
    words = words_of(text)
    hits = {i: (i, i + 1, *hit) for i, w in enumerate(words) if len(w) > 1 and (hit := matcher.find(w))}
    starts = None
    lower = text.lower() if text else ""
    for start, end, run in mixed_of(lower):
        if hit := matcher.find(run):
            starts = starts or [m.start() for m in _WORD.finditer(lower)]
            first, behind = bisect_left(starts, start), bisect_left(starts, end)
            if not any(i in hits and hits[i][-1] == 0 for i in range(first, behind)):
                for i in range(first, behind):
                    hits.pop(i, None)
                hits[first] = (first, behind, *hit)
    return words, [hits[i] for i in sorted(hits)]


def features(text: str | None, matcher: Matcher) -> tuple[list[float], list[tuple[int, str, int]]]:
    """Match statistics of one text, and the matches (word position, entry, edits)."""
    words, matches = find_all(text, matcher)
    if not matches:
        return [0.0] * FEATURES, []
    abuse = quoted = exact = edited = top = shares = 0.0
    for i, behind, _, weight, edits in matches:
        near = words[max(0, i - WINDOW):i] + words[behind:behind + WINDOW]
        quote = sum(w in QUOTES for w in words[max(0, i - 2):behind + 2]) >= 2 or any(w in SPEECH for w in near)
        share = EDIT_SHARE ** edits
        if edits:
            edited += weight
        else:
            exact += weight
        top, shares = max(top, share * weight), shares + share
        quoted += share * quote
        abuse += share * (not quote) * (1 + any(w in ADDRESS for w in near))
    kinds = len({entry for _, _, entry, _, _ in matches})
    return [math.log1p(exact), math.log1p(edited), top, math.log1p(kinds), math.log1p(abuse), quoted / shares,
            math.log1p(1000 * len(matches) / len(words))], [(i, entry, edits) for i, _, entry, _, edits in matches]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last weight is the intercept."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep), z.T @ (y - p) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(sample: DataFrame) -> tuple[dict[str, float], np.ndarray | None, float]:
    """(lexicon, model weights, share of toxic documents) from a stored sample (text, label, half)."""
    totals = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = (sum(n for (_, y), n in totals.items() if y == label) for label in (1, 0))
    share = n_toxic / max(1, n_toxic + n_clean)
    if not n_toxic or not n_clean:
        return {}, None, share
    # Bounded by the sample: entries of at least MIN_TOXIC toxic documents, the strongest first.
    strength = F.col("toxic0") + F.col("toxic1") - F.col("clean0") - F.col("clean1")
    rows = entry_counts(sample).orderBy(strength.desc(), "entry").limit(20 * LEXICON_SIZE).collect()
    halves = [build_lexicon([(r["entry"], r[f"toxic{h}"], r[f"clean{h}"]) for r in rows],
                            totals.get((h, 1), 0), totals.get((h, 0), 0)) for h in (0, 1)]
    full = build_lexicon([(r["entry"], r["toxic0"] + r["toxic1"], r["clean0"] + r["clean1"]) for r in rows], n_toxic, n_clean)

    def featured(batches):
        matchers = [Matcher(halves[1], swaps=True), Matcher(halves[0], swaps=True)]  # each half is matched by the other's lexicon
        for batch in batches:
            x = [features(t, matchers[h])[0] for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    seen = sample.select("text", "half", "label").mapInArrow(featured, "x array<double>, label int").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["label"] == 1) for r in seen])
    return full, fit_logistic(x, y), share


def score(docs: DataFrame, lexicon: dict[str, float], model: np.ndarray | None, share: float,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, score, matches (word position, lexicon entry, edits)."""
    def scored(batches):
        matcher = Matcher(lexicon, swaps=True)
        for batch in batches:
            values, found = [], []
            for text in batch.column("text").to_pylist():
                x, matches = features(text, matcher)
                values.append(share if model is None else float(1 / (1 + np.exp(-np.clip(np.r_[x, 1.0] @ model, -30, 30)))))
                found.append([{"word": i, "entry": e, "edits": d} for i, e, d in matches])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(values, pa.float64()),
                 pa.array(found, pa.list_(pa.struct([("word", pa.int64()), ("entry", pa.string()), ("edits", pa.int64())])))],
                ["id", "score", "matches"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(scored, "id long, score double, matches array<struct<word: long, entry: string, edits: long>>")


def learn_from(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray | None, float]:
    """Learn from the labelled documents that are not held out (crc32 of the id modulo 5 is not 0)."""
    usable = ~held_out(F.col("doc_id"), 5, 0)
    return learn(stored(labelled_sample(docs, labels, "toxic", usable, SAMPLE_ROWS), "labelled"))


def remove_toxic(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``; rows without an id are judged too."""
    lexicon, model, share = learn_from(all_docs, labels)

    def clean(batches):
        matcher = Matcher(lexicon, swaps=True)
        for batch in batches:
            keep = [share < threshold if model is None else
                    1 / (1 + np.exp(-np.clip(np.r_[features(t, matcher)[0], 1.0] @ model, -30, 30))) < threshold
                    for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([bool(k) for k in keep], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op4_levenshtein_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, *learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("matches").alias("n_matches"))
