"""Every training-data operator on small hostile tables, against plain brute force."""

import base64
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers_of
import pytest
import regex
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from legajo.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html_text,
    language,
    orc_tokens,
    quality,
    simhash,
    token_counts,
    toxicity,
)
from legajo.llm.common import cuts_at_spaces, shared_folder, stored

LONG = "The quick brown fox, number 12, jumps over  the lazy dog.\n\t" * 3000
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, "Hello World, it's 3 o'clock now"),
    (2, "hello world, IT'S 3 O'CLOCK NOW"),
    (3, None),
    (4, ""),
    (5, "   \n \t "),
    (6, "  two  spaces \n and ends "),
    (7, "<|endoftext|> special </s> ▁ mark"),
    (8, LONG),
    (9, BASE),
    (10, BASE + " tail"),
    (11, BASE.replace("word30", "other")),
    (12, "Ünïcödé Ärger straße \U0001f600 日本語 текст"),
    (13, "same"),
    (13, "same"),
    (None, "same"),
    (None, "no id here"),
    (14, "x.\nY a,\nb !? 'll"),
]
CLASHING = [
    "_key", "_maybe", "content", "id", "label", "head", "node", "block", "h", "key", "_id", "_gone", "_asked",
    "dkey", "row", "hashes", "_words", "item", "item_id", "pos", "n", "m", "s", "fp", "root", "left", "right",
    "shingles", "prefix", "bucket", "keys", "place", "low", "_row", "_text", "_sha", "_at", "_block", "_bits",
]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    folder = shared_folder(spark, "test-docs")
    df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def low(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (text or "").translate(str.maketrans(upper, upper.lower()))


def test_cut_texts():
    assert cuts_at_spaces("a b\nc d") and cuts_at_spaces("") and cuts_at_spaces("\n a")
    for text in ("a  b", "a \nb", "a ", "\n \nx", "a  b"):
        assert not cuts_at_spaces(text)


def test_bpe(docs, empty):
    import tiktoken

    path = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding(
        "t", pat_str=tokenizers_of.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    got = bpe.decode_ids(bpe.encode(docs, path, tokenizers_of.PATTERN), path)
    want = Counter(
        (i, np.asarray(known.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
        for i, t in TEXTS
    )
    assert Counter((r[0], bytes(r[1]), bytes(r[2])) for r in got.collect()) == want
    assert bpe.encode(empty, path, tokenizers_of.PATTERN).count() == 0


def test_bpe_blocks(docs, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", 5)
    path = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode(docs, path, tokenizers_of.PATTERN)
    decoded = bpe.decode_ids(got, path).select("doc_id", F.col("decoded").cast("string"))
    assert rows(decoded) == Counter((i, t or "") for i, t in TEXTS)


def test_bpe_small_blocks(docs):
    path = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe.encode(docs, path, tokenizers_of.PATTERN)
    small = bpe.encode(docs, path, tokenizers_of.PATTERN, block_bytes=1)
    assert rows(small) == rows(whole)
    one = docs.coalesce(1)
    blocks = bpe.split_blocks(one, "codes", 32, tokenizers_of.PATTERN, "doc_id", "text", 1)
    filled = sum(1 for _, t in TEXTS if t)
    assert filled <= blocks.select("block").distinct().count() <= filled + 1


def test_bpe_one_long_run(spark):
    import tiktoken

    path = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding(
        "t", pat_str=tokenizers_of.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}
    )
    digits = "".join(map(str, np.random.default_rng(1).integers(0, 10, 200_000)))
    texts = {1: digits, 2: " " * 200_000, 3: "a word, then " + digits[:70_000] + " and more"}
    folder = shared_folder(spark, "test-runs")
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(folder)
    encoded = bpe.encode(spark.read.parquet(folder), path, tokenizers_of.PATTERN)
    got = {r["doc_id"]: r for r in bpe.decode_ids(encoded, path).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist()
        assert len(ids) > 32_767 and ids == known.encode_ordinary(text)
        assert bytes(got[i]["decoded"]) == text.encode()


def test_token_counts(spark, docs, empty):
    import sentencepiece

    path = tokenizers_of.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = shared_folder(spark, "test-cache")
    want = Counter()
    for i, t in TEXTS:
        n = len(model.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    first = token_counts.count_tokens(docs.filter("doc_id < 9"), path, cache)
    assert sum(rows(first).values()) == 8
    before = spark.read.parquet(cache).count()
    assert rows(token_counts.count_tokens(docs, path, cache)) == want
    after = spark.read.parquet(cache)
    distinct = len({t or "" for _, t in TEXTS})
    assert before < after.count() == distinct == after.select("content").distinct().count()
    token_counts.count_tokens(docs, path, cache)
    assert spark.read.parquet(cache).count() == distinct
    assert token_counts.count_tokens(empty, path).count() == 0


def test_orc_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizers_of.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    folder = shared_folder(spark, "test-orc")
    orc_tokens.write_token_files(docs, folder, path)
    stored = orc_tokens.read_token_files(spark, folder)
    want = Counter()
    for i, t in TEXTS:
        ids = known.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, tuple(ids)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stored.collect()) == want
    found = orc_tokens.token_offsets(stored).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in TEXTS), key=lambda i: i or -1)
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    crcs = Counter((i, zlib.crc32(np.asarray(ids, "<u4").tobytes())) for i, ids in want.elements())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == crcs
    other = shared_folder(spark, "test-orc")
    orc_tokens.write_token_files(empty, other, path)
    assert orc_tokens.token_offsets(orc_tokens.read_token_files(spark, other)).count() == 0


def test_pieces_equal_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizers_of.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    parts = ["word", "Word,", "été", "it's", "12", "...", "a\nB", "\n", "\t", "Ġ", "日本", "\u3000", "",
             "\u00a0x", "\x1c", "<|endoftext|>", "<|end", "\U0001f600", "n%%%", "ß.\nÜ"]
    texts = [" ".join(rng.choice(parts[: 8 + i % 13], rng.integers(0, 12))) for i in range(3000)]
    texts += [t or "" for _, t in TEXTS] + ["", " ", " a", "a "]
    monkeypatch.setattr(orc_tokens.PieceEncoder, "JOINED", 3)
    encoder = orc_tokens.PieceEncoder(path)
    read = []  # texts the library reads
    each = encoder.each
    monkeypatch.setattr(encoder, "each", lambda texts: read.append(texts) or each(texts))
    end = np.asarray([2], "<u4").tobytes()
    for low in range(0, len(texts), 1000):
        some = texts[low : low + 1000]
        ids, ends = encoder.encode(some, end)
        got = [part.tolist() for part in np.split(ids, ends)]
        assert got == [known.encode(t, add_special_tokens=False).ids + [2] for t in some] + [[]]
    read.clear()
    ids, ends = encoder.encode(["word once été", "word it's", "été it's"])
    assert read == [[" once"], ["word", "word", "été"]]  # pieces met before are not read again
    assert "once" not in encoder.known  # met once
    assert ids[: ends[0]].tolist() == known.encode("word once été", add_special_tokens=False).ids


def test_slices_by_bytes():
    import pyarrow as pa

    sizes = [3, 0, 4, 20, 1, 1, 9, 2]
    batch = pa.record_batch({"id": list(range(8)), "text": [b"x" * n for n in sizes]})
    cuts = [c.column(0).to_pylist() for c in orc_tokens.sized_slices(batch, 8)]
    assert cuts == [[0, 1, 2], [3], [4, 5], [6], [7]]


@pytest.mark.parametrize("blocks", [1, 1 << 19])
def test_exact_groups(docs, empty, blocks):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(low(t), []).append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            digest = hashlib.sha256(text.encode()).hexdigest()
            want[i, keep, len(ids), i == keep, digest] += 1
    assert rows(exact_dedup.duplicate_groups(docs, blocks=blocks)) == want
    kept = exact_dedup.drop_duplicates(docs, blocks=blocks)
    assert kept.columns == docs.columns
    assert sorted(low(r["text"]) for r in kept.collect()) == sorted(groups)
    assert {r["doc_id"] for r in kept.filter("text = 'same'").collect()} == {13}
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0


@pytest.mark.parametrize("broadcast", [1, 1 << 19])
def test_filter_grows_with_the_texts(spark, broadcast):
    """Many more texts than the smallest filter has blocks: few false alarms, no repeat missed."""
    once = spark.range(60_000).select(F.col("id").alias("_id"), F.xxhash64("id").alias("_key"))
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    keys = once.unionByName(once.filter("_id < 500").select("*", twice.alias("_turn")).drop("_turn"))
    flagged = exact_dedup.flagged_rows(keys, broadcast)
    assert flagged.count() == 61_000
    assert flagged.filter("_id < 500 and not _maybe").count() == 0
    assert flagged.filter("_id >= 500 and _maybe").count() < 0.05 * 60_000


def test_one_text_in_a_third_of_the_rows(spark):
    """A text above the share that is sent back by broadcast, and rows equal in id and text."""
    folder = shared_folder(spark, "test-hot")
    many = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, F.lit("Hot text")).otherwise(
            F.concat(F.lit("text "), (F.col("id") / 3).cast("int").cast("string"))
        ).alias("text"),
        F.create_map(F.lit("a"), F.col("id")).alias("_row"),
    )
    many.write.parquet(folder)
    many = spark.read.parquet(folder)
    for blocks in (1, 1 << 19):
        groups = exact_dedup.duplicate_groups(many, blocks=blocks)
        assert groups.count() == 9000
        hot = groups.filter("group_size = 3000")
        assert {(r["n"], r["k"]) for r in hot.groupBy("keep_id").agg(
            F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()} == {(3000, 1)}
        kept = exact_dedup.drop_duplicates(many, blocks=blocks)
        assert kept.count() == 3001 and kept.select("text").distinct().count() == 3001
        assert kept.filter("text = 'Hot text'").first()["doc_id"] == 8998
        assert kept.filter("doc_id = -1").count() == 0


def fingerprint(text, words=4):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles or [b" ".join(parts)] if parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, empty):
    prints = [(i, fingerprint(t)) for i, t in TEXTS]
    root = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    want = Counter()
    for a, (i, x) in enumerate(prints):
        group = [prints[b][0] for b in range(len(prints)) if root[b] == root[a]]
        want[i, f"{x:016x}", min((g for g in group if g is not None), default=None)] += 1
    assert rows(simhash.fingerprint_groups(docs)) == want
    assert simhash.fingerprint_groups(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 4])
def test_links_at_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    nodes = {int(x) for x in rng.integers(-(2**62), 2**62, 40)}
    for node in list(nodes):
        for flips in range(1, 8):
            bits = rng.choice(62, flips, replace=False)
            nodes.add(node ^ sum(1 << int(b) for b in bits))
    nodes = sorted(nodes)
    root = {n: n for n in nodes}
    pairs = [
        (a, b) for a in nodes for b in nodes
        if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    ]
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for pair in pairs for n in pair}
    points = spark.createDataFrame([(n, n) for n in nodes], "node bigint, head bigint")
    keys = simhash.block_keys(F.col("head"), radius, len(nodes))
    got = {r["node"]: r["root"] for r in simhash.link_groups(points, keys, radius).collect()}
    assert got == {n: root[n] for n in linked}


def test_near_duplicates(docs, empty):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _ in TEXTS} - {r["doc_id"] for r in kept.collect()}
    assert gone == {2, 4, 5, 10, 11}  # 4 and 5 have no words, as 3
    assert simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"cells": 1 << 13}])
def test_near_duplicates_at_the_bound(spark, options):
    rng = np.random.default_rng(8)
    passage = [f"common{i}" for i in range(30)]
    texts = {}
    for i in range(400):
        words = [f"w{w}" for w in rng.integers(0, 10**6, rng.integers(60, 200))]
        words += passage * (i % 3 == 0)
        copy = list(words)
        for at in rng.choice(len(words), max(1, len(words) // 45), replace=False):
            copy[at] = f"new{at}"
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(copy)
    texts[900] = " ".join([*texts[0].split(), *texts[1].split()[:40] * 50])  # a part many times
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}

    def similarity(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    planted = [similarity(2 * i, 2 * i + 1) for i in range(400)]
    assert sum(0.8 <= s < 0.85 for s in planted) > 50 and sum(s < 0.8 for s in planted) > 20
    root = {i: i for i in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b and similarity(a, b) >= 0.8]
    for _ in range(3):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["node"]: r["root"] for r in simhash.near_groups(docs, **options).collect()}
    assert got == {i: root[i] for pair in pairs for i in pair}


def test_near_duplicates_go_through_fingerprints(spark, monkeypatch):
    """Fingerprint links are verified and kept; the prefix filter adds what they miss."""
    base = [f"word{i}" for i in range(150)]
    texts = [" ".join(base), " ".join([*base[:149], "x"]), " ".join([*base[:130], *"abcdefgh"])]
    texts += ["a b c d", " ".join(f"other{i}" for i in range(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links, calls = simhash.print_groups, []

    def spied(*args):
        groups = links(*args)
        calls.append({r["node"]: r["root"] for r in groups.collect()})
        return groups

    monkeypatch.setattr(simhash, "print_groups", spied)
    got = {r["node"]: r["root"] for r in simhash.near_groups(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    assert calls == [{0: 0, 1: 0}]


def test_benchmark_items(spark, docs, empty):
    items = spark.createDataFrame(
        [
            (1, " ".join(f"Word{i}" for i in range(20, 40))),
            (2, " ".join(f"word{i}" for i in range(20, 38)) + " a"),
            (3, "never seen anywhere in these texts at all"),
            (4, None),
            (5, ""),
            (6, "SAME"),
            (6, "SAME"),
            (None, "no id, here!"),
        ],
        "item_id bigint, text string",
    )
    found = decontaminate.contaminated(docs, items)
    want = {(9, 1), (10, 1), (9, 2), (10, 2), (13, 6), (None, 6), (None, None)}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    exact = found.filter("doc_id = 9 and item_id = 1").collect()[0]
    assert exact["similarity"] == 1.0 and exact["start"] == 20
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in TEXTS} - {9, 10, 13, None}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.filter("false")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    clean = [f"calm{i}" for i in range(200)]
    bad = ["vilebad", "vileworse", "nastyword", "grimthing"]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(clean, 40))
        toxic = i % 3 == 0
        if toxic:
            words[10:13] = rng.choice(bad, 3)
        junk = i % 4 == 0
        text = " ".join(f"{w}###" if junk else w for w in words)
        texts.append((i, text, ["en", "xx"][i % 2]))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(labelled, docs, empty):
    train, labels = labelled
    model = toxicity.fit(train, labels)
    held = toxicity.score(train, model).join(labels, "doc_id").filter(
        "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    )
    assert held.filter("(score >= 0.5) <> (toxic = 1)").count() == 0
    passages = held.filter("toxic = 1").select("passages").collect()
    assert passages and all(p[0][0]["first"] <= 12 and p[0][0]["last"] >= 10 for p in passages)
    got = toxicity.score(docs, model)
    assert got.count() == len(TEXTS) and got.filter("score >= 0.5 or score is null").count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == len(TEXTS)
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(train, labels.filter("false"))
    assert toxicity.score(docs, blank).select("score").distinct().collect() == [(0.5,)]


def test_segments_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(1, 14)).astype(float)
        got = toxicity.maximal_segments(scores)
        best = max(
            (scores[a : b + 1].sum() for a in range(len(scores)) for b in range(a, len(scores)))
        )
        assert max((s for *_, s in got), default=0) == max(best, 0)
        assert all(scores[a : b + 1].sum() == s > 0 for a, b, s in got)
        ends = [e for a, b, _ in got for e in (a, b)]
        assert ends == sorted(ends)


def test_quality(labelled, docs, empty):
    train, labels = labelled
    model = quality.fit(train, labels)
    held = quality.score(train, model).join(labels, "doc_id").filter(
        "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    )
    assert held.filter("(score >= 0.3) <> (quality = 1)").count() == 0
    got = quality.score(docs, model)
    assert got.count() == len(TEXTS)
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(empty, model).count() == 0
    blank = quality.fit(train, labels.filter("false"))
    assert quality.score(docs, blank).select("score").distinct().collect() == [(0.5,)]


def test_language(spark, docs, empty):
    words = {
        "aa": ["the", "and", "with", "house", "there"],
        "bb": ["der", "und", "nicht", "straße", "über"],
        "cc": ["дом", "это", "слово", "и"],
    }
    rng = np.random.default_rng(5)
    texts = [
        (i, " ".join(rng.choice(words[lang], 30)), lang)
        for i, lang in enumerate(list(words) * 30)
    ]
    texts.append((999, "unlabelled words", None))
    train = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    mixed = spark.createDataFrame(
        [
            (1, " ".join(words["aa"] * 4 + words["bb"] * 8)),
            (2, "это дом 12"),
            (3, None),
            (4, "12 ... !"),
            (5, ""),
        ],
        "doc_id bigint, text string",
    )
    got = {r["doc_id"]: r for r in language.identify(mixed, model).collect()}
    assert [(s["lang"], s["first"], s["last"]) for s in got[1]["spans"]] == [
        ("aa", 0, 19),
        ("bb", 20, 59),
    ]
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["bb", "cc", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, model).count() == len(TEXTS)
    assert language.identify(empty, model).count() == 0
    none = language.fit(train.filter("false"))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_viterbi_is_the_best_labelling():
    from itertools import product

    rng = np.random.default_rng(11)
    for words in (1, 2, 5):
        scores = rng.normal(size=(6, words, 3)).astype(np.float32)
        lengths = rng.integers(1, words + 1, 6)
        for d in range(6):
            scores[d, lengths[d] :] = 0
        labels = language.viterbi(scores, lengths, 0.7)

        def value(d, path):
            jumps = sum(a != b for a, b in zip(path, path[1:]))
            return sum(scores[d, t, s] for t, s in enumerate(path)) - 0.7 * jumps

        for d in range(6):
            best = max(value(d, p) for p in product(range(3), repeat=int(lengths[d])))
            assert value(d, labels[d, : lengths[d]]) == pytest.approx(best, abs=1e-5)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><nav><ul><li><a href="/x">Menu one</a></li></ul></nav><header>Site name</header>
<div class="cookie-notice">We use cookies</div><article><h1>The   title &amp; more</h1>
<p>First <b>bold</b>  words of a long enough text &lt;here&gt;<br>and on.<p>Second
paragraph with several words in it.</p><div class="ad">Buy this</div><aside>See also</aside>
<form><input value="x">Subscribe <button>Go</button></form><ul><li>Point one of the list</li>
<li>Point two of the list</li></ul><p>Last paragraph of the text, it is here.</p></article>
<section id="comments"><p>I do not agree with this at all, dear writer.</p></section>
<footer>&copy; nobody</footer></body></html>"""
MAIN = """The title & more
First bold words of a long enough text <here> and on.
Second paragraph with several words in it.
Point one of the list
Point two of the list
Last paragraph of the text, it is here."""


def test_main_text(spark):
    pages = spark.createDataFrame(
        [(1, "u1", PAGE), (2, "u2", None), (3, "u3", ""), (4, "u4", "plain words only"),
         (5, "u5", "<p>cut <b>off &am"), (6, None, "<nav><a>x</a></nav>"), (None, "u7", PAGE)],
        "page_id bigint, url string, html string",
    ).withColumn("text", F.lit("clash"))
    for weights in ((html_text.WORDS, html_text.TAGS), html_text.fit(pages)):
        got = {r["url"]: r for r in html_text.extract(pages, weights).collect()}
        assert got["u1"]["text"] == got["u7"]["text"] == MAIN
        assert got["u2"]["text"] == got["u3"]["text"] == got[None]["text"] == ""
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    got = {r["url"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got["u4"] == "plain words only" and got["u5"] == "cut off &am"
    assert html_text.extract(pages.filter("false")).count() == 0
    assert html_text.fit(pages.filter("false")) == (html_text.WORDS, html_text.TAGS)


def test_long_page_without_end():
    page = "<article><p>" + "word <i class='x>" * 2000
    assert isinstance(html_text.main_text(page), str)
    assert regex.fullmatch(r"(a )*a", html_text.main_text("<p>" + "a <br>" * 50_000))


ARTICLE = "<p>One paragraph of the text.</p><p>Two more words here.</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<html class='has-header'><body class='no-sidebar'>{}</body></html>",
        "<body class='with-sidebar'><main id='search'>{}</main></body>",
        "<body class='menu'><div class='post header-dark'>{}</div></body>",
        "<article class='post has-comments'>{}</article>",
        "<article class='share'>{}</article>",
        "<div class='sidebar'>Side words</div>{}<div id='site-footer'>Foot</div>",
        "<div role='navigation'>Side words</div>{}<ul class='x comment-list'><li>No</li></ul>",
        "<svg class='i'/>{}",
        "<math/>{}",
        "<svg-icon>{}",
        "<svg><text>drawn</text></svg>{}",
        "<svg viewBox='0 0 1 1' ><path d='x'/></svg>{}<template-x>",
        "<script src='a>b/'>no()</script>{}",
    ],
)
def test_frames_and_foreign_elements(page):
    want = "One paragraph of the text.\nTwo more words here."
    assert html_text.main_text(page.format(ARTICLE)) == want


def test_clean_rows_that_share_an_id_stay(spark):
    """Rows of a null or repeated id go only with their own text, and names of columns do not matter."""
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(None, f"before {item} behind"), (None, "clean and short"), (1, item), (1, "clean too"), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]
    )
    frame = stored(frame, "clean-rows")
    benchmark = spark.createDataFrame([(9, item, "x")], "item_id bigint, text string, id string")
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, "clean and short"), (1, "clean too"), (2, ""),
    ]
    near = simhash.drop_near_duplicates(frame)
    assert near.columns == frame.columns and near.count() == len(rows)


def test_deep_pages_take_linear_time():
    """200,000 open tags of one name, of changing names, and closing tags that fit nothing."""
    start = time.perf_counter()
    for page in (
        "<div>" * 200_000 + "deep text",
        "<i><div><b>" * 70_000 + "</span>" * 70_000 + "deep text",
        "<p><span>" * 100_000 + "deep text" + "</em></p>" * 100_000,
    ):
        found = html_text.pieces(page)
        assert any(p.text == "deep text" for p in found)
    assert time.perf_counter() - start < 60
