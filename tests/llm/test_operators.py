"""Training-data operators: brute force on small fixtures and the defined results of odd inputs."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_ledger.llm import decontamination, entropy_mixing, hilbert_sharding, line_dedup, minmax_dedup
from corpus_ledger.llm import token_counts, toxicity, warc_derivatives, weighted_sampling
from corpus_ledger.llm.common import components, positions
from corpus_ledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
# Extra columns whose names clash with those the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, row long, size long, "
          "key string, word string, component string, shard string, label string")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def make_docs(spark, texts, sources=None):
    """texts: (id, text) pairs."""
    rows = [(i, t, "en", (sources or {}).get(i, "a"), len(t or ""), 7, 7, 7, "k", "w", "c", "s", "l") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Random texts with copies, near copies, null, empty, blank, one-word and long texts, a null and a repeated id."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    out = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        out.append((i, " ".join(words)))
    for i in range(60, 90):
        words = out[rng.randrange(20)][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words).upper() if i % 2 else "\n".join(words)))
    out += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One"), (None, "no id here"), (105, "é " * 30_000)]
    return out + [out[3]]


def empty(docs):
    return docs.limit(0)


def test_hilbert_curve_steps(spark):
    """Every cell once, and neighbours on the curve differ by one step in one dimension."""
    for dims, bits in ((2, 3), (3, 2)):
        n = 1 << bits
        cells = spark.range(n ** dims).select(F.array(*[(F.floor(F.col("id") / n ** d) % n).cast("long") for d in range(dims)]).alias("c"))
        path = cells.withColumn("h", hilbert_sharding.hilbert_index("c", dims, bits)).orderBy("h").collect()
        assert [r.h for r in path] == list(range(n ** dims))
        assert all(sum(abs(a - b) for a, b in zip(p.c, q.c)) == 1 for p, q in zip(path, path[1:]))


def test_sharding(spark, texts):
    docs = make_docs(spark, texts)
    rows = hilbert_sharding.shard_documents(docs, 7).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in texts)
    assert hilbert_sharding.shard_documents(empty(docs)).count() == 0


def test_mixing(spark, texts):
    sources = {i: ["b", "a", None, "c"][(i or 0) % 4] for i, _ in texts}
    docs = make_docs(spark, texts, sources)
    rows = entropy_mixing.entropy_mix(docs, "doc_id", "source", entropy_mixing.word_count()).collect()
    sizes = Counter()
    for i, t in texts:
        sizes[sources[i]] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    # Targets by raising the water level until the shares add up.
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < sum(sizes.values()) else (low, mid)
    taken = Counter()
    for r in rows:
        assert 0 <= r.copies <= 3 and math.isclose(r.target, min(3 * sizes[r.source], low * weight[r.source]), rel_tol=1e-6)
        taken[r.source] += r.size * r.copies
    for r in rows:  # half of a document larger than that cannot be mended
        largest = max(x.size for x in rows if x.source == r.source)
        assert abs(taken[r.source] - r.target) <= max(0.02 * r.target + 5, largest / 2)
    again = entropy_mixing.entropy_mix(docs, "doc_id", "source", entropy_mixing.word_count()).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in again)
    assert entropy_mixing.entropy_mix(empty(docs), "doc_id", "source", entropy_mixing.word_count()).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(k, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, texts, k):
    docs = make_docs(spark, texts)
    sets = [(i, shingles(t, k)) for i, t in texts if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    rows = minmax_dedup.near_duplicates(docs, shingle_words=k).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (root(r.id), root(r.id) == r.id)
            assert r.n_shingles == len(dict(sets)[r.id])
    kept = minmax_dedup.deduplicate(docs, shingle_words=k)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None} | {i for i in parent if root(i) == i}
    assert minmax_dedup.near_duplicates(empty(docs)).count() == 0


def test_pairs_outside_the_main_component(spark):
    """An original with edited copies, and copies edited too far: every link is found, whichever document leads."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        words = list(base)
        for j in rng.sample(range(60), rng.choice([1, 2, 3, 4, 8])):
            words[j] = f"x{i}{j}"
        texts.append((i, " ".join(words)))
    texts.append((80, " ".join(base)))
    sets = {i: shingles(t, 2) for i, t in texts}
    label = dict(zip(sets, sets))
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.id: r.component_id for r in minmax_dedup.near_duplicates(make_docs(spark, texts), shingle_words=2).collect()}
    assert got == label


def test_buckets_of_three_led_by_the_smallest_id(spark):
    """Two linked documents whose common buckets hold only one more, the smallest id and their hub, linked to neither."""
    texts, linked = [], []
    for family in (12, 71, 87, 123, 132, 161):  # two bands of two values put these so
        lead = [f"f{family}w{i}" for i in range(80)]

        def edited(words, places, mark):
            return [f"{mark}{w}" if i in places else w for i, w in enumerate(words)]

        x = edited(lead, range(0, 28, 3), "x")
        y = edited(x, (70, 76), "y")
        others = [edited(lead, random.Random(family * 3 + k).sample(range(80), 16), f"z{k}") for k in range(3)]
        texts += [(10 * family + k, " ".join(words)) for k, words in enumerate([lead, x, y, *others])]
        linked.append((10 * family + 1, 10 * family + 2))
    sets = {i: shingles(t, 2) for i, t in texts}
    near = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert near == linked
    rows = minmax_dedup.near_duplicates(make_docs(spark, texts), shingle_words=2, bands=2, rows=2).collect()
    assert {(r.component_id, r.id) for r in rows if r.id != r.component_id} == set(linked)


def words_of_item(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark, texts, monkeypatch):
    items = [("b", texts[5][1]), ("a", texts[7][1][:40]), ("c", None), ("d", "..."), (None, "no id here"), ("e", "é é é"), ("e", texts[9][1])]
    docs, benchmark = make_docs(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    expected = []
    for i, t in texts:
        words, hit, found = words_of_item(t), set(), set()
        for item, text in items:
            w = words_of_item(text)
            for k in range(max(1, len(w) - 9) if w else 0):
                window = w[k:k + 10]
                for at in range(len(words) - len(window) + 1):
                    if words[at:at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(item)
        expected.append((i, len(words), len(hit), tuple(sorted(found, key=lambda x: (x is None, x or "")))))
    for block in (decontamination.BLOCK_WORDS, 20):  # one block, then several
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        rows = decontamination.benchmark_matches(docs, benchmark).collect()
        got = [(r.id, r.n_words, len({p for s, e in zip(r.starts, r.ends) for p in range(s, e)}), tuple(r["items"])) for r in rows]
        assert Counter(got) == Counter(expected)
    assert decontamination.benchmark_matches(empty(docs), benchmark).count() == 0
    assert all(not r["items"] for r in decontamination.benchmark_matches(docs, benchmark.limit(0)).collect())


def test_proximity(spark):
    docs = make_docs(spark, [(1, "a b c d"), (2, "a x b c d"), (3, "a x y z b c d")])
    benchmark = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    for slop, ids in ((0, {1}), (1, {1, 2}), (3, {1, 2, 3})):
        found = decontamination.benchmark_matches(docs, benchmark, slop=slop).filter(F.size("items") > 0)
        assert {r.id for r in found.collect()} == ids


def test_line_dedup(spark, texts):
    lined = [(i, t.replace("a ", "a\n") if t and i and i < 200 and i != 105 else t) for i, t in texts]
    rows = line_dedup.near_duplicate_lines(make_docs(spark, lined)).collect()
    sets = {}
    for i, t in lined:
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(w for w in re.split(r"[ \t\r]", line.lower()) if w)
            if s:
                sets.setdefault(s, []).append((-1 if i is None else i, k))
    links = Counter()
    for a in sets:
        for b in sets:
            links[a] += a != b and 100 * len(a & b) >= 80 * len(a | b)
    lines = Counter((-1 if r.id is None else r.id, r.line, r.links) for r in rows)
    assert lines == Counter((i, k, links[s]) for s, places in sets.items() for i, k in places)
    assert line_dedup.near_duplicate_lines(empty(make_docs(spark, lined))).count() == 0
    short = make_docs(spark, [(1, "a b c d e\nkeep"), (2, "x\na b c d e"), (3, "a b c d\nz")])
    assert {r.id: r.text for r in line_dedup.without_duplicate_lines(short).collect()} == {1: "a b c d e\nkeep", 2: "x", 3: "z"}


def test_links_of_a_large_group_make_no_pairs(spark):
    """60 near copies of a line: links and removals as by brute force, the pairs of the group not compared."""
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(words)] * 3 + [" ".join([*words[:i % 40], f"x{i}", *words[i % 40 + 1:]]) for i in range(60)] + ["p q r s t", "p q r s t u", ""]
    docs = make_docs(spark, [(None if i == 5 else 100 - i, line) for i, line in enumerate(lines)])
    order = [(-1 if i == 5 else 100 - i, frozenset(line.split())) for i, line in enumerate(lines) if line]
    near = [(s, t) for s in {s for _, s in order} for t in {s for _, s in order} if s != t and 100 * len(s & t) >= 80 * len(s | t)]
    first = {s: min(i for i, t in order if t == s) for _, s in order}
    expected = {i: (sum(s == a for a, _ in near), i != first[s] or any(s == a and first[b] < first[s] for a, b in near)) for i, s in order}
    rows = line_dedup.near_duplicate_lines(docs).collect()
    assert {-1 if r.id is None else r.id: (r.links, r.removed) for r in rows} == expected
    stored_lines = line_dedup.stored(line_dedup.with_set(line_dedup.split_lines(line_dedup.numbered(docs, "doc_id", "text"))), "lines")
    classes = line_dedup.stored(line_dedup.word_classes(stored_lines, line_dedup.rarity_levels(stored_lines), 80), "classes")
    members = line_dedup.hub_members(classes, stored_lines, 80)
    assert members.count() > 50
    assert line_dedup.candidate_pairs(classes, members, 80).count() < 200 < 60 * 59 // 2


def test_near_copies_that_share_an_edit(spark):
    """Members of a group too far from its hub to be linked for certain: the words apart from the hub that they share decide."""
    words = [f"w{i}" for i in range(60)]
    edits = [[(7 * i + 11 * k) % 60 for k in range(5)] for i in range(30)]
    lines = [" ".join(words)] * 3 + [" ".join(f"x{i % 4}_{j}" if j in edit else w for j, w in enumerate(words)) for i, edit in enumerate(edits)]
    order = [(i, frozenset(line.split())) for i, line in enumerate(lines)]
    sets = {s for _, s in order}
    links = Counter(s for s in sets for t in sets if s != t and 100 * len(s & t) >= 80 * len(s | t))
    docs = make_docs(spark, list(enumerate(lines)))
    assert {r.id: r.links for r in line_dedup.near_duplicate_lines(docs).collect()} == {i: links[s] for i, s in order}
    stored_lines = line_dedup.stored(line_dedup.with_set(line_dedup.split_lines(line_dedup.numbered(docs, "doc_id", "text"))), "lines")
    classes = line_dedup.stored(line_dedup.word_classes(stored_lines, line_dedup.rarity_levels(stored_lines), 80), "classes")
    members = line_dedup.hub_members(classes, stored_lines, 80)
    of = {r.cid: r.hub for r in members.collect()}
    met = [(of.get(r.a), of.get(r.b)) for r in line_dedup.candidate_pairs(classes, members, 80).collect()]
    assert len(of) > 20 and not [p for p in met if p[0] is not None and p[0] == p[1]]
    near = line_dedup.hub_links(members, 80).collect()
    assert 0 < len(near) == len({(r.a, r.b) for r in near}) < sum(links.values()) // 2


def test_sieve_keeps_its_map_out_of_the_plan(spark):
    """A map of the wanted keys is broadcast as rows; as a constant it filled the driver, once for each plan that is kept."""
    wanted = line_dedup.stored(spark.range(0, 1_000_000, 10), "wanted")
    rows = line_dedup.sieve(spark.range(1_000_000), wanted, ["id"])
    assert len(rows._jdf.queryExecution().toString()) < 20_000
    few = rows.groupBy((F.col("id") % 10 == 0).alias("in")).agg(F.sum(F.col("may").cast("int")).alias("n"), F.count(F.lit(1)).alias("of")).collect()
    assert {r["in"]: r["n"] for r in few}[True] == 100_000 and {r["in"]: r["n"] for r in few}[False] < 100_000
    assert line_dedup.sieve(spark.range(5), wanted.limit(0), ["id"]).filter("may").count() == 0


def test_fingerprints(spark, texts):
    unique = [(i, t) for i, t in texts if i is not None][:-1]
    docs = make_docs(spark, unique)
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/op9/documents.parquet")
    rows = {r.doc_id: r for r in weighted_sampling.op9_weighted_sampling(spark, path.rsplit("/", 1)[0]).collect()}
    ordered = sorted((i, t or "") for i, t in unique)
    gaps = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t, edited))
        if a | b:
            gaps.append(rows[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.05 and np.std(gaps) < 0.15
    by_text = {}
    for i, t in ordered:
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_token_counts_match_unigram_model(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = token_counts.read_vocabulary()
    pieces = [*vocabulary.items(), ("<none>", -1e9)]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=len(pieces) - 1)).model
    docs = make_docs(spark, texts)
    rows = token_counts.token_counts(docs, vocabulary).collect()
    expected = Counter((i, sum(len(model.tokenize("▁" + w)) for w in (t or "").split())) for i, t in texts)
    assert Counter((r.id, r.n_tokens) for r in rows) == expected
    scores = token_counts.PrefixScores({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -1.0})
    assert [scores.count(w) for w in ("ab", "aba", "abc", "☃a")] == [1, 2, 1, 4] and scores.steps == 6
    assert token_counts.token_counts(empty(docs), vocabulary).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_matcher():
    rng = random.Random(2)
    matcher = toxicity.Matcher({"hello": 1.0, "world": 1.0, "abc": 1.0, "stemm*": 1.0})
    for _ in range(3000):
        word = list(rng.choice(["hello", "world", "abc", "stemmxyz", "help"]))
        for _ in range(rng.randrange(3)):
            word[rng.randrange(len(word)):][:rng.randrange(2)] = []
            word.insert(rng.randrange(len(word) + 1), rng.choice("helowrdabc")) if rng.random() < 0.5 else word.pop() if len(word) > 1 else None
        word = "".join(word)
        near = {e: edit_distance(word, e) for e in ("hello", "world")} | {"abc": 0 if word == "abc" else 9}
        near["stemm*"] = min(edit_distance(word[:k], "stemm") for k in range(len(word) + 1))
        best = min(near.values())
        found = matcher.find(word)
        assert (found is None) == (best > 1) and (found is None or found[2] == best == near[found[0]])


def test_toxicity_context_and_odd_inputs(spark, texts):
    matcher = toxicity.Matcher({"wretch": 3.0})
    plain, quoted = (toxicity.features(t, matcher)[0] for t in ("you wretch go away", 'he said "wretch" again'))
    assert plain[4] > quoted[4] and plain[5] == 0.0 and quoted[5] == 1.0
    docs, labels = make_docs(spark, texts), spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, *toxicity.learn_from(docs, labels)).collect()
    assert len(rows) == len(texts) and {r.score for r in rows} == {0.0}
    assert toxicity.remove_toxic(docs, docs, labels).count() == len(texts)


def test_toxicity_of_misspelled_terms():
    """Digits, symbols, a swap and a second edit are found, and their context tells quotation from abuse."""
    lexicon = {"idiot": 3.0, "moron": 3.0, "wretched": 3.0, "vermin*": 3.0, "scumbag": 3.0}
    matcher = toxicity.Matcher(lexicon, swaps=True)
    spelled = {"idi0t": "idiot", "m0ron": "moron", "id_iot": "idiot", "mor*n": "moron", "idoit": "idiot", "Wr3tch3d": "wretched",
               "v3rmin": "vermin*", "$cumbag": "scumbag", "wrteche": "wretched"}
    for term, entry in spelled.items():
        plain, found = toxicity.features(f"you {term}, go away", matcher)
        quoted, _ = toxicity.features(f'he said "{term}" again', matcher)
        assert [(i, e) for i, e, _ in found] == [(1, entry)] and found[0][2] > 0, term
        assert plain[2] > 0 and plain[4] > quoted[4] and plain[5] == 0.0 and quoted[5] == 1.0, term
    exact = toxicity.features("you idiot, go away", matcher)[0]
    assert exact[2] > toxicity.features("you idi0t, go away", matcher)[0][2]
    assert toxicity.features("idiot-like x_idiot 12 idiot!", matcher)[1] == [(0, "idiot", 0), (3, "idiot", 0), (4, "idiot", 0)]
    assert not toxicity.features("www.example.org 2024-01-02 a1b2c3 co-op it's", matcher)[1]


@pytest.mark.parametrize("name, label, least", [("op2_rff_quality", "quality", 0.95), ("op4_levenshtein_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_warc_round_trip(spark, tmp_path):
    html = ('<html lang="en"><head><title>T &amp; t</title><style>x{}</style></head><body><p>One <b>two</b></p><script>no</script>'
            '<p>drei é</p><a href="/x">link</a><![foo</body></html>')
    pages = spark.createDataFrame([(1, "http://a/", html, "x"), (2, None, None, "x"), (3, "http://b/", "", "x"), (1, "http://a/", html, "x")],
                                  "page_id long, url string, html string, block string")
    made = warc_derivatives.responses(pages).cache()
    derived = warc_derivatives.derive(made)
    by_kind = {(r.page, r.type): r for r in derived.collect()}
    response = made.filter("page = '1'").first()
    text, meta = by_kind["1", "conversion"], by_kind["1", "metadata"]
    assert text.block.split("\n")[:2] == ["One two", "drei é"] and "title: T & t\r\n" in meta.block and "outlink: /x\r\n" in meta.block
    assert text.refers_to == meta.refers_to == response.record_id and text.payload_digest == response.payload_digest
    assert by_kind["2", "conversion"].block == by_kind["3", "conversion"].block == ""
    everything = made.unionByName(derived).drop("page")
    warc_derivatives.write_warc(everything, str(tmp_path / "warc"))
    back = warc_derivatives.read_warc(spark, str(tmp_path / "warc"))
    assert Counter(tuple(r) for r in back.collect()) == Counter(tuple(r) for r in everything.collect())
    assert warc_derivatives.derive(warc_derivatives.responses(pages.limit(0))).count() == 0


def test_warc_of_others_keeps_header_fields(spark, tmp_path):
    """read_warc -> derive -> write_warc -> read_warc on a file with further HTTP and WARC header fields."""
    http = (b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nDate: Thu, 01 Jan 2026 00:00:00 GMT\r\nSet-Cookie: a=1\r\n"
            b"Set-Cookie: b=2\r\nServer:x\r\nX-Long: one\r\n two\r\n\r\n<p>caf\xe9 Hello")
    head = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n"
            "WARC-Date: 2026-01-01T00:00:00Z\r\nWARC-IP-Address: 192.0.2.1\r\nWARC-Concurrent-To: <urn:uuid:2>\r\n"
            "WARC-Concurrent-To: <urn:uuid:3>\r\nContent-Type: application/http; msgtype=response\r\n"
            f"content-length:{len(http)}\r\n\r\n").encode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(head + http + b"\r\n\r\n"))
    read = warc_derivatives.read_warc(spark, str(tmp_path / "in"))
    further = "WARC-IP-Address: 192.0.2.1\r\nWARC-Concurrent-To: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:3>\r\n"
    assert [r.fields for r in read.collect()] == [further]
    derived = warc_derivatives.derive(read)
    rows = {r.type: r for r in derived.collect()}
    expected = ["Source-HTTP-content-type: text/html", "Source-HTTP-Date: Thu, 01 Jan 2026 00:00:00 GMT", "Source-HTTP-Set-Cookie: a=1",
                "Source-HTTP-Set-Cookie: b=2", "Source-HTTP-Server: x", "Source-HTTP-X-Long: one two",
                *("Source-" + line for line in further.split("\r\n")[:-1])]
    assert {kind: r.fields.split("\r\n")[:-1] for kind, r in rows.items()} == {"metadata": expected, "conversion": expected}
    assert rows["conversion"].block == "caf\ufffd Hello" and rows["conversion"].refers_to == "<urn:uuid:1>"
    assert "served-type: text/html\r\n" in rows["metadata"].block and "page" not in derived.columns
    warc_derivatives.write_warc(read.unionByName(derived), str(tmp_path / "out"))
    back = warc_derivatives.read_warc(spark, str(tmp_path / "out"))
    assert Counter(tuple(r) for r in back.collect()) == Counter(tuple(r) for r in read.unionByName(derived).collect())


@pytest.mark.parametrize("html, lines", [
    ("<html><head><title>x</title><p>Hello", ["Hello"]),
    ("<head><meta charset=utf-8><style>a{}</style><title>x</title>Hello <b>you</b>", ["Hello you"]),
    ("<head><title>x</title><noscript><p>no</p></noscript><script>s</script></head><p>Hello", ["Hello"]),
    ("<head><noscript><link href=x></head><body>Hello", ["Hello"]),
    ("<body><div>a<noscript><img src=x></div><p>Hello", ["a", "Hello"]),
    ("<body><template><p>in</template>a <noscript>b</noscript>c<p>Hello</body>", ["a c", "Hello"]),
    ("<body><p>a<noscript><p>Hello", ["a", "Hello"]),
    ("<body><div><template><i>b</div>Hello</body>", ["b", "Hello"]),
    ("<p>a<script>no</script>b<li>c<li>d</ul></p>", ["ab", "c", "d"]),
    ("<head><style>x{}</style><body><head>Hello</head> you", ["Hello you"]),
])
def test_page_text_without_end_tags(html, lines):
    """A head without </head> and <body>, and held elements that are never closed, lose no page text."""
    assert warc_derivatives.PageText().result(html).lines == lines


def test_positions_and_components(spark):
    numbered, n = positions(spark.range(1000).withColumn("v", F.col("id") % 3), ["v"], "at")
    rows = numbered.orderBy("at").collect()
    assert n == 1000 and [r["at"] for r in rows] == list(range(1000)) and [r.v for r in rows] == sorted(r.v for r in rows)
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}


def test_pipeline_keeps_columns_and_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert {r.doc_id: r.text for r in after.collect()}.items() <= before.items(), name
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {r.shard for r in out.select("shard").distinct().collect()} == set(range(16))
