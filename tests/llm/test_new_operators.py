"""Operators 11 to 13: brute force on small fixtures and the defined results of odd inputs."""

import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from corpus_ledger.llm import conversation_repair as repair
from corpus_ledger.llm import embedding_dedup as near
from corpus_ledger.llm import vector_clusters as clusters

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
CLASHES = ", row long, rep long, pos long, conv string, _h string, cluster string, id string, block int, bucket int"


# ------------------------------------------------------------------ conversation repair
def marked(rows):
    """(role, text, fault) of rows in order: None, 'cut' or 'gone'; and the counts of faults."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        said = text.strip(BLANKS)
        which = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
        seen.add((role, text))
        if which is not None:
            counts[which] += 1
        out.append((role, text, {None: None, 0: "gone", 1: "gone", 2: "cut"}[which]))
    return out, counts


def every_repair(rows):
    """All edit sequences with at most two inserts before a row or at the end: (cost, audit, repaired)."""
    if not rows:
        for tail in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            yield 5 * len(tail), "I" * len(tail), [(r, "") for r in tail]
        return
    (role, text, fault), rest = rows[0], rows[1:]
    extra = 5 if fault == "cut" else 0
    own = [(2, "D", [])]
    if fault != "gone":
        own += [(extra, "K", [(role, text)])] + [(1 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
    for lead in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
        for (c, a, o), (c2, a2, o2) in itertools.product(own, list(every_repair(rest))):
            yield (5 * len(lead) + c + c2, "I" * len(lead) + a + a2, [(r, "") for r in lead] + o + o2)


def well_formed(turns):
    text = "".join(r[0] if r and r[0] in "sua" else "?" for r, _ in turns)
    text = text[1:] if text.startswith("s") and len(text) > 1 else text
    return text == "ua" * (len(text) // 2)


def best_repair(rows):
    return min((r for r in every_repair(rows) if well_formed(r[2])), key=lambda r: r[:2])


def conversations(spark, rows):
    """rows: (conv, turn, role, text)."""
    return spark.createDataFrame([(c, t, r, x, 7, 7, 7, "c", "h", "k", "i", 3, 3) for c, t, r, x in rows],
                                 "conv_id long, turn int, role string, text string" + CLASHES)


def repaired(spark, rows, block):
    edits, summary = repair.repair_conversations(conversations(spark, rows), block=block)
    counts = {r.conv: r for r in summary.collect()}
    return {r.conv: (counts[r.conv], r.audit, r.repaired_sha256) for r in repair.digests(edits).collect()}


def expected(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    plain, faults = marked([(r, x) for _, r, x in rows])
    cost, audit, out = best_repair(plain)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *faults, illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


@pytest.mark.parametrize("block", [2, 1024])
def test_repair_is_the_least_of_all_repairs(spark, block):
    rng = random.Random(block)
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    words = ["Yes.", "No!", "cut off", "", " \n", None, "Why?\t", "Yes."]
    cases = {None: [(None, "user", "Hi."), (1, "assistant", "Yes.")], 900: [(5, "system", "Be kind.")],
             901: [(None, None, None)], 902: [(3, "user", "a."), (3, "user", "a."), (3, "assistant", "b."), (9, "user", "a.")]}
    for c in range(60):
        cases[c] = [(rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles[:3] if c % 2 else roles), rng.choice(words))
                    for _ in range(rng.randint(1, 3))]
    rows = [(c, t, r, x) for c, some in cases.items() for t, r, x in some]
    rng.shuffle(rows)
    got = repaired(spark, rows, block)
    assert set(got) == set(cases)
    for c, some in cases.items():
        s, audit, digest = got[c]
        assert (s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, s.cost, audit, digest) == expected(some), (c, some)


def test_long_conversation_is_cut_into_blocks(spark):
    """One conversation holds nearly all rows; blocks of 8 need three levels and give what one block gives."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 300)}{rng.choice('.!?x')}") for t in range(700)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "word " * 50_000 + ".")]
    assert repaired(spark, rows, 8) == repaired(spark, rows, 1024)
    edits, _ = repair.repair_conversations(conversations(spark, rows), block=8)
    turns = [(r.role, r.text) for r in edits.filter("conv = 1 and edit != 'D'").orderBy("pos", "step").collect()]
    assert well_formed(turns)


def test_repair_of_nothing(spark):
    edits, summary = repair.repair_conversations(conversations(spark, []))
    assert edits.count() == summary.count() == repair.digests(edits).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in repair.damaged(conversations(spark, rows)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    import zlib
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "A b c" if len(text) > 1 else " ")], 3: [(role, text)] * 2,
                4: [("user", text)]}.get(fate, [(role, text)])
        assert got[c, t] == want


# ------------------------------------------------------------------ clustering
def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 7, 7, "c", "h", "k", "i", 3, 3) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, label int" + CLASHES.replace(", pos long", ""))


def lloyd(rows, dim, k, rounds, scale=1024):
    rows = [(i, [math.floor(x * scale) if abs(x) < 2 ** 53 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centers = [list(v) for _, v in sorted(rows, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in rows]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, n) in zip(rows, assign()):
            own[n].append(v)
        centers = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centers)]
    return sorted(((i if i is not None else -1), n, min(d, 2 ** 63 - 1)) for (i, _), (d, n) in zip(rows, assign())), centers


def clustered(frame, **options):
    got, centers = clusters.cluster_vectors(frame, **options)
    return sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in got.collect()), centers


@pytest.mark.parametrize("spread", [1.0, 0.002, 1e30])
def test_clusters_equal_plain_rounds(spark, spread):
    """Few distinct values give ties between centroids; large ones leave 64-bit integers."""
    spread = float(np.float32(spread))
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.choice([-1, 0, 1]) * spread)) for _ in range(4)]) for i in range(300)]
    rows += [(None, [spread] * 4), (5, rows[5][1]), (400, None), (401, []), (402, [1.0] * 5), (403, [1.0, None, 0.0, 0.0]),
             (404, [math.nan] * 4), (405, [math.inf, 0.0, 0.0, 0.0]), (406, [0.0] * 4)]
    frame = vectors(spark, rows)
    for k in (1, 8, 25):
        assert clustered(frame, dim=4, clusters=k, rounds=4) == lloyd(rows, 4, k, 4)


def test_few_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert clustered(vectors(spark, rows), dim=2) == lloyd(rows, 2, 8, 10)
    assert clustered(vectors(spark, []), dim=2) == ([], [])
    assert clustered(vectors(spark, rows), dim=3) == ([], [])


def test_tree_visits_fewer_centroids_and_keeps_ties():
    rng = np.random.default_rng(2)
    centers = (rng.integers(0, 8, size=(60, 1)) * 1000 + rng.integers(0, 5, size=(60, 3))).tolist()
    x = rng.integers(-10, 8000, size=(200, 3))
    who, best = clusters.nearest(x, clusters.vantage_point_tree(centers))
    away = ((x[:, None, :] - np.array(centers)[None]) ** 2).sum(axis=2)
    assert (best == away.min(axis=1)).all() and (who == away.argmin(axis=1)).all()


# ------------------------------------------------------------------ near vectors
def linked(rows, least):
    """Links, smallest reachable id of each row by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations([i for i, o in enumerate(ok) if o], 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        x, y = (x / np.abs(x).max(), y / np.abs(y).max())
        if len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= least:
            n[a] += 1
            n[b] += 1
            old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
            comp = [new if c == old else c for c in comp]
    smallest = {c: min((i for (i, _), d in zip(rows, comp) if d == c and i is not None), default=None) for c in comp}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((i, k, smallest[c], i is None or i == smallest[c] or smallest[c] is None)
                   for (i, _), k, c in zip(rows, n, comp)), key=key)


def found(frame, **options):
    rows = [(r.id, r.n_links, r.component_id, r.kept) for r in near.near_vectors(frame, **options).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block", [4, 512])
def test_links_equal_all_pairs(spark, block):
    """Copies, a large family of near copies, chains, and odd vectors; small blocks split the large buckets."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[0] + rng.normal(size=16) * 0.12) for i in range(60)]
    rows += [(200 + i, base[1]) for i in range(30)] + [(240 + i, base[1] * 3) for i in range(5)]
    step = base[2]
    for i in range(10):
        step = step + rng.normal(size=16) * 0.25
        rows.append((300 + i, step))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [math.nan] * 16), (404, [math.inf] + [1.0] * 15),
             (405, [None] + [1.0] * 15), (406, [1e-40] * 16), (407, [1e38] * 16), (408, [1.0] * 3), (409, [2.0] * 3),
             (410, [5.0]), (411, [7.0]), (412, [-7.0]), (200, [float(np.float32(x)) for x in base[1]]), (None, [1.0] * 3)]
    assert found(vectors(spark, rows), block=block, tables=40) == linked(rows, 0.9)


def test_no_vectors(spark):
    assert found(vectors(spark, [])) == []
    assert found(vectors(spark, [(1, None), (2, [0.0])])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_hadamard_is_orthogonal():
    for d in (1, 2, 8, 64, 512):
        h = near.hadamard(np.eye(d))
        assert np.allclose(h @ h.T, np.eye(d)) and np.allclose(np.abs(h), 1 / math.sqrt(d))


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.9 share a bucket all but about 3 times in 10,000."""
    rng = np.random.default_rng(3)
    x = near.unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z = near.unit(z - (z * x).sum(axis=1)[:, None] * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * z
    a, b = (near.bucket_keys(v, near.TABLES, near.HASHES, near.PROBES, near.SEED) for v in (x, y))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() > 0.998
