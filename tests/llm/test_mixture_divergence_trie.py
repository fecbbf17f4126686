"""Source mixture, source divergence and conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.llm import divergence, mixture, prefix_trie
from legajo.llm.common import stored

RNG = random.Random(7)
#: names the three operators use inside
CLASHING = [
    "id", "size", "n", "row", "each", "more", "copies", "target", "tilt", "units", "step", "_source",
    "_size", "_at", "_hash", "_rank", "term", "total", "place", "block", "ids", "ns", "tile", "a", "b",
    "value", "rank", "part", "item", "p", "q", "conv", "depth", "x1", "p1", "q1", "chars", "head", "h",
    "_piece", "_row", "_start",
]


def clashing(df):
    return stored(df.select("*", *[F.lit("x").alias(c) for c in CLASHING]), "clashing")


def words(n):
    return " ".join(RNG.choice(["Alpha", "beta", "gamma1", "\u00e9t\u00e9", "d-d"]) for _ in range(n))


DOCS = (
    [(i, "s1", "en", words(RNG.randint(1, 60))) for i in range(60)]
    + [(100 + i, "s2", "en", "copy of one text") for i in range(40)]
    + [(200 + i, None, "de", words(RNG.randint(0, 9))) for i in range(25)]
    + [(300, "s3", None, None), (301, "s3", "en", ""), (302, "s4", "en", " \n\t "), (303, "", "", "x")]
    + [(400, "s5", "en", words(5000)), (401, "s5", "en", "tail of it")]
    + [(500, "s6", "fr", "same same")] * 3
    + [(None, "s6", "fr", "same again"), (None, None, None, None)]
)
SCHEMA = "doc_id bigint, source string, lang string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(DOCS, SCHEMA))


# --- mixture ---------------------------------------------------------------------------------
def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_mixture(docs):
    result = mixture.mix(docs)
    assert result.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    rows = result.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, size_of(t)) for i, *_, t in DOCS)
    sizes = Counter()
    for _, source, _, text in DOCS:
        sizes[source] += size_of(text)
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    source_of = {i: s for i, s, *_ in DOCS if i is not None}
    taken = Counter()
    for r in rows:
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            source = source_of[r.doc_id]
            assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
            taken[source] += r.taken
    for source, shortest in (("s1", 60), ("s2", 4), (None, 9)):
        assert abs(taken[source] - want[source]) <= shortest
    assert sorted(map(repr, rows)) == sorted(map(repr, mixture.mix(docs.repartition(7)).collect()))


def test_mixture_gives_the_rows(docs):
    counted = Counter()
    for r in mixture.mix(docs).collect():
        counted[r.doc_id] += r.copies
    mixed = mixture.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +counted
    assert mixture.mix(docs.filter("false")).count() == 0


def test_rates_solve_the_dual(spark):
    """Tilted rates against a bisection of the same equation."""
    sizes = np.array([1, 3, 10, 40, 700])
    numbers = np.array([50, 20, 30, 10, 2])
    rows = [("s", int(z), int(n)) for z, n in zip(sizes, numbers)]
    histogram = stored(spark.createDataFrame(rows, "source string, size bigint, n bigint"), "h")
    whole = int((sizes * numbers).sum())
    mean = (sizes**2 * numbers).sum() / whole

    def words_taken(tilt):
        return (sizes * numbers * np.exp(np.minimum(tilt * sizes / mean, np.log(2)))).sum()

    for portion in (0.02, 0.4, 1.0, 1.3, 1.97):
        goal = portion * whole
        targets = spark.createDataFrame(
            [("s", whole, goal)], "source string, source_size bigint, target double"
        )
        solved = mixture.tilts(histogram, targets, 2).first()
        low, high = -1e4, 1e4
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words_taken(middle) < goal else (low, middle)
        assert abs(words_taken(solved.tilt) - goal) <= 0.3  # words
        assert abs(solved.tilt - low) <= 0.01 * max(1, abs(low))


# --- divergence --------------------------------------------------------------------------------
def brute_audit(rows, min_docs, top):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for _, s, g, t in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(g, s, [w.translate(low) for w in ws]) for g, s, ws in docs]
    out = []
    for lang in {g for g, *_ in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if held[w] >= min_docs) for _, s, _ in own}
        counts[None] = sum(counts.values(), Counter())
        v = len(kept)
        shares = {
            s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v) for w in kept}
            for s, c in counts.items()
        }
        price = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts:
            if s is None:
                continue
            pairs = [(o, sum(price(shares[s][w], shares[o][w]) for w in kept)) for o in counts if o not in (None, s)]
            terms = [
                (w, price(shares[s][w], shares[None][w]))
                for w in kept
                if counts[s][w] and shares[s][w] > shares[None][w]
            ]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, n, i + 1) for i, (x, n) in enumerate(items[:most])]
    return Counter(out)


@pytest.mark.parametrize("block, tile, held", [(8192, 16, 300_000), (2, 1, 3), (3, 2, 10)])
def test_divergence(docs, monkeypatch, block, tile, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", held)
    result = divergence.audit(docs, min_docs=3, top=4)
    assert Counter(map(tuple, result.collect())) == brute_audit(DOCS, 3, 4)


def test_divergence_without_terms(docs):
    result = divergence.audit(docs, min_docs=10**6)
    assert Counter(map(tuple, result.collect())) == brute_audit(DOCS, 10**6, 10)
    assert divergence.audit(docs.filter("false")).count() == 0


def test_shares_of_huge_counts_are_exact():
    whole = 9 * 10**15
    counts = [0, 1, 12345678901234, whole - 10]
    got = divergence.share(np.array(counts), whole).tolist()
    assert got == [1 + 10**9 * (c + 2) // whole for c in counts]


# --- trie -----------------------------------------------------------------------------------------
def brute_trie(rows, every=100, heads=6):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = tuple(own.get(c - c % every, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node])
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    return Counter(
        (
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(n)).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def hostile_turns():
    rng, rows = random.Random(3), []
    for c in range(320):
        if c == 100:
            continue  # its hundred has no base
        text = "start" if rng.random() < 0.5 else f"first {rng.randint(0, 5)}"
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", None]), text if t == 0 else rng.choice(["a", "bb", "", None])))
    rows += [(900 + c, t, "user", f"copy {t}") for c in range(40) for t in range(4)]
    rows += [(777, t, "user", f"long {t % 3}") for t in range(150)]  # one long chain
    rows += [(778, t, "user", f"long {t % 3}" if t < 90 else "off") for t in range(120)]
    rows += [(800, None, "user", "x" * 50_000), (800, 0, None, None), (800, 1, "user", "y"), (801, 1, "user", "y")]
    rows += [(None, 1, "user", "nobody"), (-205, 1, "user", "below zero")]
    rows += [(802, 1, "user", "again")] * 3
    return rows


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("small, piece, bucket", [(4096, 4096, 20_000), (6, 16, 40)])
def test_trie(spark, monkeypatch, small, piece, bucket):
    monkeypatch.setattr(prefix_trie, "SMALL", small)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BUCKET", bucket)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = hostile_turns()
    turns = clashing(spark.createDataFrame(rows, TURNS))
    assert Counter(map(tuple, prefix_trie.trie(turns).collect())) == brute_trie(rows)


def test_trie_without_conversations(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert prefix_trie.trie(none).count() == 0


def test_decomposition_sums_any_forest():
    rng = random.Random(5)
    for shape in ("path", "star", "random"):
        n = 400
        parents = [-1] + [
            {"path": v - 1, "star": 0, "random": rng.randrange(v)}[shape] for v in range(1, n)
        ] + [-1, n]
        values = [(rng.randint(0, 9), rng.randint(0, 10**12)) for _ in parents]
        weights, sums = [1] * len(parents), [list(v) for v in values]
        for v in reversed(range(len(parents))):
            if parents[v] >= 0:
                weights[parents[v]] += weights[v]
                sums[parents[v]][0] += sums[v][0]
                sums[parents[v]][1] += sums[v][1]
        assert prefix_trie.decomposed(parents, weights, values) == [tuple(s) for s in sums]
