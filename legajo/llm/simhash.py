"""SimHash fingerprints, their links within a Hamming radius, and near-duplicates.

Two fingerprints within a radius agree on at least ``blocks - radius`` of
``blocks`` bit blocks, so every choice of that many blocks is a key under which
linked fingerprints meet.  The number of blocks grows with the logarithm of the
number of fingerprints, which keeps few strangers under one key.

What meets is checked against pivot distance tables: the Hamming distances of
every fingerprint to fixed reference fingerprints are computed once.  By the
triangle inequality a pair can only be linked if no coordinate of the two rows
differs by more than the radius; survivors are verified on the bits.

Large groups never give all their pairs.  Under each key first only the smallest
fingerprint is compared with the others; the links found are reduced to
components; then only pairs under one key in different components are compared.
That finds the same components, as a link inside a component changes nothing.
Texts of one template may lie on both sides of the bound; for those, further rounds
compare another node of each key with the others before the pairs that are left.

Near-duplicates by Jaccard similarity meet by a prefix filter instead, which misses
no pair: in one order of all shingles, two sets of similarity t share one of their
first n - ceil(t n) + 1 shingles (n: the size of the set).  Any order will do; rare
shingles come first, so that common passages bring few strangers together.  Most of
them differ in few bits of their fingerprints, so fingerprint links, verified on the
texts, come first, and the prefix filter compares what those have not brought together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import scratch, slices, small_side, stored, text_bytes

#: Reference fingerprints; each distance takes one byte of a packed long.
PIVOTS = 8
#: Ids of a join side that is broadcast; a larger side is shuffled.
ASKED_BROADCAST = 1_000_000
#: Counters of shingles, and how many travel in one row.
CELLS, CHUNK = 1 << 22, 1 << 13
#: Shingles counted at once in a task.
COUNTED = 1 << 18
#: Further rounds that compare one node of each key with the others, for near-duplicate texts.
ROUNDS = 3
#: Prefix shingles that one task compares, about.
BUCKET = 400_000
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text's bytes, A-Z lower-cased; repeats included.

    Words are the runs between ASCII white space.  A text of fewer words has one
    shingle, all of them; a text without words has none.
    """
    from xxhash import xxh64_intdigest

    parts = data.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n = max(1, len(parts) - words + 1)
    behind = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    return np.fromiter(
        (xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n], behind, strict=True)),
        np.uint64,
        n,
    )


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):  # in pieces: 64 bytes a hash
        bits = hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    chosen = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(chosen.view(np.int64)[0])


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of each hash (turn 0: the same), for fingerprints of more than 64 bits."""
    if not turn:
        return hashes
    x = hashes ^ np.uint64((GOLDEN * turn) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(
    docs: DataFrame,
    words: int = 4,
    longs: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, fp): per row of docs a fingerprint of ``longs`` times 64 bits as array of longs.

    A null or empty text has the fingerprint zero.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch.column(1).to_pylist():
                hashes = shingle_hashes(data or b"", words)
                rows.append([majority_bits(mixed(hashes, t)) for t in range(longs)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "fp"]
            )

    return docs.select(id_col, text_bytes(text_col).alias("text")).mapInArrow(
        hashed, f"id {id_type}, fp array<bigint>"
    )


def pivot_distances(head: Column) -> Column:
    """Distances of a 64-bit fingerprint to the reference fingerprints, a byte each."""
    packed = F.lit(0).cast("bigint")
    for p in range(PIVOTS):
        pivot = F.xxhash64(F.lit(f"reference fingerprint {p}"))
        distance = F.bit_count(head.bitwiseXOR(pivot)).cast("bigint")
        packed = packed.bitwiseOR(F.shiftleft(distance, 8 * p))
    return packed


def close(left: dict[str, Column], right: dict[str, Column], radius: int) -> Column:
    """No pivot coordinate differs by more than the radius, and then no more bits differ."""
    gaps = [
        F.abs(
            F.shiftrightunsigned(left["distances"], 8 * p).bitwiseAND(F.lit(255))
            - F.shiftrightunsigned(right["distances"], 8 * p).bitwiseAND(F.lit(255))
        )
        <= radius
        for p in range(PIVOTS)
    ]
    within = gaps[0]
    for gap in gaps[1:]:
        within = within & gap
    return within & (F.bit_count(left["head"].bitwiseXOR(right["head"])) <= radius)


def block_keys(head: Column, radius: int, count: int) -> Column:
    """Keys of which any two 64-bit fingerprints within the radius share one.

    With b blocks a key holds the bits of b - radius blocks; b is the smallest
    number whose keys have at least log2(count) - 4 bits.
    """
    blocks = radius + 2
    while 64 * (blocks - radius) / blocks < log2(max(count, 2)) - 4:
        blocks += 1
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for place, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(place), head.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (left, right): root is the smallest node reached.

    Every round takes the smallest label of the neighbours and then the label of
    that label, until no label changes.  Each round is written to the shared folder.
    """
    both = links.select(F.col("left").alias("node"), F.col("right").alias("other"))
    both = stored(
        both.union(both.select("other", "node")).filter("node <> other").distinct(), "links"
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("low"))
        .select("node", F.least("node", "low").alias("root")),
        "labels",
    )
    changed = 1
    while changed:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "root"), "other")
            .groupBy("node")
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = stored(
            lower.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")),
            "labels",
        )
        changed = step.filter("root <> old").limit(1).count()
        labels = step.select("node", "root")
    return labels


def link_groups(
    points: DataFrame,
    keys: Column,
    radius: int,
    verify: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, root) of all linked points.

    ``points`` has node (unique), head and the columns of ``keys``.  Points that
    meet under a key, pass the pivot table and differ in at most ``radius`` bits
    are linked if ``verify``, which gets and returns pairs (left, right), keeps them.
    """
    met = points.select(
        "node", "head", pivot_distances(F.col("head")).alias("distances"), F.explode(keys).alias("key")
    )
    verify = verify or (lambda pairs: pairs)
    return met_groups(met, ["head", "distances"], lambda a, b: close(a, b, radius), verify)


def met_groups(
    met: DataFrame,
    held: list[str],
    near: Callable[[dict[str, Column], dict[str, Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    rounds: int = 0,
    known: DataFrame | None = None,
) -> DataFrame:
    """(node, root) of all linked nodes of the rows (key, node, held columns).

    Nodes that meet under a key are linked if ``near``, of the held columns of
    both, and then ``verify`` keep the pair.  ``rounds`` bounds the further rounds of
    one node per key; it does not change the result.  ``known`` has groups (node, root)
    that are linked already, whose pairs are not verified again.
    """
    firsts = met.groupBy("key").agg(
        F.min("node").alias("first"),
        F.max("node").alias("last"),
        *[F.min_by(c, "node").alias(f"first_{c}") for c in held],
    )
    shared = stored(met.join(firsts.filter("first <> last").drop("last"), "key"), "shared-keys")

    def columns(prefix: str) -> dict[str, Column]:
        return {c: F.col(f"{prefix}{c}") for c in held}

    stars = (
        shared.filter((F.col("node") != F.col("first")) & near(columns(""), columns("first_")))
        .select(F.col("first").alias("left"), F.col("node").alias("right"))
        .distinct()
    )
    if known is not None:
        for end in ("left", "right"):
            roots = known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            stars = stars.join(roots, end, "left")
        # null: in no group yet
        apart = ~F.coalesce(F.col("left_root") == F.col("right_root"), F.lit(False))
        stars = stars.filter(apart).select("left", "right")
    links = stored(verify(stored(stars, "pairs")), "verified")
    if known is not None:
        links = links.union(known.filter("node <> root").select("root", "node"))
    for turn in range(rounds + 1):
        rooted = stored(
            shared.select("key", "node", *held)
            .join(components(links), "node", "left")
            .withColumn("root", F.coalesce("root", "node")),
            "rooted",
        )
        mixed_keys = (
            rooted.groupBy("key")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("low <> high")
            .select("key")
        )
        open_ = rooted.join(mixed_keys, "key", "left_semi")
        if turn == rounds:
            break
        hub = F.max_by(F.struct("node", "root", *held), F.xxhash64("node", F.lit(turn)))
        hubs = open_.groupBy("key").agg(hub.alias("hub"))
        hub_near = near(columns(""), {c: F.col(f"hub.{c}") for c in held})
        stars = (
            open_.join(hubs, "key")
            .filter((F.col("root") != F.col("hub.root")) & hub_near)
            .select(
                F.least("node", "hub.node").alias("left"), F.greatest("node", "hub.node").alias("right")
            )
            .distinct()
        )
        found = stored(verify(stored(stars, "pairs")), "verified")
        if found.isEmpty():
            break
        links = links.union(found)
    other = open_.select("key", *[F.col(c).alias(f"other_{c}") for c in ("node", *held, "root")])
    across = (
        open_.join(
            other,
            (open_["key"] == other["key"])
            & (F.col("root") < F.col("other_root"))
            & near(columns(""), columns("other_")),
        )
        .select(F.col("node").alias("left"), F.col("other_node").alias("right"))
        .distinct()
    )
    return components(links.union(verify(stored(across, "pairs"))))


def fingerprint_groups(
    docs: DataFrame,
    words: int = 4,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    Fingerprints of at most ``radius`` differing bits are linked; component_id is
    the smallest id reachable over links (null ids never are; null where a
    component has no other).  Null and empty texts have the fingerprint zero and
    are linked like any other.  Repeated rows stay.  Other columns are not read.
    """
    prints = stored(
        fingerprints(docs, words, 1, id_col, text_col).select("id", F.col("fp")[0].alias("head")),
        "fingerprints",
    )
    distinct = stored(prints.groupBy("head").agg(F.min("id").alias("low")), "distinct")
    points = distinct.select(F.col("head").alias("node"), "head")
    groups = link_groups(points, block_keys(F.col("head"), radius, distinct.count()), radius)
    rooted = distinct.join(groups, F.col("head") == F.col("node"), "left").select(
        "head", "low", F.coalesce("root", "head").alias("root")
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(lows, "root").select("head", "component_id"), "components")
    return prints.join(named, "head").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("head"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def similar_pairs(
    pairs: DataFrame, docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str
) -> DataFrame:
    """The pairs of document ids whose sets of shingles have at least the given Jaccard similarity."""
    ids = stored(
        pairs.select(F.col("left").alias("_id")).union(pairs.select("right")).distinct(), "asked"
    )
    asked = docs.join(small_side(ids, ASKED_BROADCAST), F.col(id_col) == F.col("_id"), "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [
                np.unique(shingle_hashes(t or b"", words)).view(np.int64)
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    sets = stored(
        asked.select(id_col, text_bytes(text_col).alias("text")).mapInArrow(
            hashed, f"id {id_type}, shingles array<bigint>"
        ),
        "shingle-sets",
    )
    left = sets.select(F.col("id").alias("left"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("right"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(left, "left")
        .join(right, "right")
        .filter(common >= similarity * (F.size("a") + F.size("b") - common))
        .select("left", "right")
        .distinct()
    )


def shingle_levels(docs: DataFrame, words: int, cells: int, text_col: str) -> tuple[bytes, int]:
    """How common the shingles are: a byte per counter, growing with the log of its count.

    A shingle belongs to the counter of its last bits.  The table has the same
    size for any number of documents.  Also the number of shingles of all sets.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(cells, np.uint32), [], 0

        def add() -> None:
            if held:
                places = (np.concatenate(held) & np.uint64(cells - 1)).astype(np.uint32)
                places, times = np.unique(places, return_counts=True)
                counts[places] += times.astype(np.uint32)
                held.clear()

        for batch in slices(batches):
            for data in batch.column(0).to_pylist():
                held.append(np.unique(shingle_hashes(data or b"", words)))
                size += len(held[-1])
                if size >= COUNTED:
                    add()
                    size = 0
        add()
        for place, part in enumerate(counts.reshape(-1, CHUNK)):
            if part.any():
                packed = zstandard.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"place": [place], "counts": [packed]}, schema=schema)

    def summed(parts: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for data in parts.column("counts"):
            total += np.frombuffer(zstandard.decompress(data.as_py()), np.uint32)
        levels = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)
        return pa.table(
            {"place": parts.column("place")[:1], "levels": [levels.tobytes()], "n": [int(total.sum())]}
        )

    schema = pa.schema([("place", pa.int32()), ("counts", pa.binary())])
    rows = (
        docs.select(text_bytes(text_col).alias("text"))
        .mapInArrow(counted, "place int, counts binary")
        .groupBy("place")
        .applyInArrow(summed, "place int, levels binary, n bigint")
        .collect()  # a byte per counter
    )
    table = bytearray(cells)
    for r in rows:
        table[r["place"] * CHUNK : (r["place"] + 1) * CHUNK] = r["levels"]
    return bytes(table), sum(r["n"] for r in rows)


def dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, from bits that the counters of shingles do not use."""
    return (keys.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)


def prefixes(
    docs: DataFrame,
    levels: bytes,
    buckets: int,
    words: int,
    similarity: float,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """(bucket, keys, nodes, sizes, places): the first shingles of every row of docs, in arrays.

    Of two sets with the similarity one holds at least ``similarity`` times the
    shingles of the larger, so the prefixes have one in common.  Texts without
    words share the prefix zero.  ``size`` is that of the set, ``place`` that of the
    shingle in the prefix.

    Keys that several rows of a task share are in bucket -1, and once more, with place
    -1, in the bucket of the key: so a key reaches its bucket once from a task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        ids, sizes, firsts = [], [], []
        size = 0

        def arrays(bucket: list[int], parts: list[np.ndarray], entries: list[pa.Array]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            columns = [c.take(pa.array(np.concatenate(parts))) for c in entries]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), *(pa.ListArray.from_arrays(ends, c) for c in columns)],
                names=["bucket", "keys", "nodes", "sizes", "places"],
            )

        def passed_on() -> Iterator[pa.RecordBatch]:
            if not firsts:
                return
            counts = [len(f) for f in firsts]
            keys = np.concatenate(firsts)
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
            lengths = np.repeat(np.asarray(sizes, np.int32), counts)
            nodes = pa.concat_arrays(ids).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            several = times[which] > 1
            at = np.flatnonzero(several)
            if len(at):
                yield arrays([-1], [at], [pa.array(keys), nodes, pa.array(lengths), pa.array(places)])
            marks = at[np.unique(keys[at], return_index=True)[1]]
            places[marks] = -1
            once = np.concatenate([np.flatnonzero(~several), marks])
            bucket = dealt(keys[once], buckets)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            yield arrays(
                found.astype(np.int32).tolist(),
                np.split(once[order], starts[1:]),
                [pa.array(keys), nodes, pa.array(lengths), pa.array(places)],
            )
            ids.clear(), sizes.clear(), firsts.clear()

        for batch in slices(batches):
            ids.append(batch.column(0))
            for data in batch.column(1).to_pylist():
                found = np.unique(shingle_hashes(data or b"", words))
                n = len(found)
                sizes.append(n)
                order = np.argsort(level[found & np.uint64(len(level) - 1)], kind="stable")
                first = found[order[: n - ceil(similarity * n - 1e-9) + 1]]
                firsts.append(first.view(np.int64) if n else np.zeros(1, np.int64))
                size += len(firsts[-1])
            if size >= COUNTED:
                yield from passed_on()
                size = 0
        yield from passed_on()

    return docs.select(id_col, text_bytes(text_col).alias("text")).mapInArrow(
        cut,
        f"bucket int, keys array<bigint>, nodes array<{id_type}>, sizes array<int>, places array<int>",
    )


def shared_prefixes(prefixes: DataFrame) -> DataFrame:
    """(key, node, n, place): the entries of stored prefixes whose key several rows have."""
    names = ["keys", "nodes", "sizes", "places"]

    def repeated(table: pa.Table) -> pa.Table:
        columns = [table.column(c).combine_chunks().flatten() for c in names]
        keys, places = columns[0].to_numpy(), columns[3].to_numpy()
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        at = pa.array(np.flatnonzero((times[which] > 1) & (places >= 0)))
        return pa.table([c.take(at) for c in columns], names=["key", "node", "n", "place"])

    id_type = prefixes.schema["nodes"].dataType.elementType.simpleString()
    schema = f"key bigint, node {id_type}, n int, place int"
    met = (
        prefixes.filter("bucket >= 0").groupBy("bucket").applyInArrow(repeated, schema)
    )
    in_task = prefixes.filter("bucket < 0").select(F.inline(F.arrays_zip(*names)))
    return met.unionByName(in_task.toDF("key", "node", "n", "place"))


def print_groups(
    docs: DataFrame, words: int, radius: int, verify: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(node, root) of the rows (id, text) linked by fingerprints whose texts ``verify`` keeps."""
    prints = stored(
        fingerprints(docs, words, 1, "id", "text").select(
            F.col("id").alias("node"), F.col("fp")[0].alias("head")
        ),
        "fingerprints",
    )
    return link_groups(prints, block_keys(F.col("head"), radius, prints.count()), radius, verify)


def near_groups(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    cells: int = CELLS,
    id_col: str = "doc_id",
    text_col: str = "text",
    print_words: int = 4,
    radius: int = 4,
) -> DataFrame:
    """(node, root) of the documents linked by near-duplicate texts.

    Links are all pairs with a Jaccard similarity of at least ``similarity`` on sets
    of word shingles, verified on the texts.  Rows of one id count as one document,
    which is linked by any of its texts; null ids are left out.

    Fingerprints of ``print_words``-word shingles within ``radius`` bits are linked first;
    the prefix filter then finds the pairs whose fingerprints lie farther apart.  These
    two numbers and ``cells``, the number of counters of shingles (a power of two), do not
    change the result.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    id_col, text_col = "id", "text"

    def verify(pairs: DataFrame) -> DataFrame:
        return similar_pairs(pairs, docs, words, similarity, id_col, text_col)

    known = stored(print_groups(docs, print_words, radius, verify), "print-groups")
    levels, shingles = shingle_levels(docs, words, cells, text_col)
    buckets = int(shingles * (1 - similarity)) // BUCKET + 12
    firsts = prefixes(docs, levels, buckets, words, similarity, id_col, text_col)
    met = stored(shared_prefixes(stored(firsts, "prefixes")), "shared-prefixes")

    def near(a: dict[str, Column], b: dict[str, Column]) -> Column:
        # common shingles from the first one on, which is this key for one key of the pair
        left = F.least(a["n"] - a["place"], b["n"] - b["place"])
        return left * (1 + similarity) >= similarity * (a["n"] + b["n"]) - 1e-6

    return met_groups(
        met,
        ["n", "place"],
        near,
        verify,
        ROUNDS,
        known,
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the smallest id stays.

    All columns stay as they were, whatever their names; rows with null id stay too.
    Rows of one id are one document and stay or go together.
    """
    with scratch(docs.sparkSession):
        groups = near_groups(docs, id_col=id_col, **options)
        gone = stored(groups.filter("node <> root").select("node"), "near-copies", keep=True)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id")
    )
    return rows.join(
        small_side(gone, ASKED_BROADCAST), F.col("_id") == F.col("node"), "left_anti"
    ).select("row.*")
