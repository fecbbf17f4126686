"""The trie of rebuilt conversations, rolled up by centroid decomposition.

Every prefix of a conversation has a key: its length and the exclusive-or of hashes of
its turns and their places, 128 bits.  Keys are running aggregates, so a conversation
of any length is cut into pieces.  Equal sequences are merged before anything else.
A node is a distinct key; its smallest member owns it.

Nodes of one member set in a row form a chain, kept as one vertex (owner, members).  A
vertex then ends a sequence or branches.  With 2 for each sequence that ends at it and 1
for each child, less 1, every vertex weighs at least 1, and all below and with it weigh
twice their sequences less 1: subtree weights are known without a roll-up.

The parent edges are then decomposed.  The vertices over half of whose component lies
below them are the way from its centroid to its top; the lowest is the centroid.  The
component falls into the parts below the centroid and the rest above.  Totals of the
parts, with the centroid's own, are the centroid's result and are added along the way to
the top, and every part is treated alike.  Weights halve each round, however deep the
trie is.  Parts of at most ``SMALL`` are finished inside tasks that take many of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import stored, text_or_empty
from legajo.operators.scaling import dense_ordinals

#: Rows of a key that one window holds; weight of a component, and vertices, that one task takes.
PIECE, SMALL, BUCKET = 4096, 4096, 20_000
#: Conversation numbers of one chunk when the ends of a node are hashed.
CHUNK_BITS = 12
KEY = ["depth", "p1", "p2"]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, str],
    aggregate: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
) -> DataFrame:
    """Running aggregates per key along the whole-number column ``order``: {name: column}.

    A key is cut into pieces of ``PIECE`` places; between them travels a row per piece.
    """
    cut = df.withColumn("_piece", F.expr(f"{order} div {PIECE}"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_piece")
        .agg(*[aggregate(F.col(c)).alias(f"_of_{n}") for n, c in values.items()])
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in (*keys, "_piece")],
            *[aggregate(F.col(f"_of_{n}")).over(before).alias(f"_from_{n}") for n in values],
        )
        .filter("_key__piece > 0")  # few keys are so long
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    same = F.lit(True)
    for k in (*keys, "_piece"):
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    within = cut.withColumns(
        {f"_in_{n}": aggregate(F.col(c)).over(inside) for n, c in values.items()}
    )
    return within.join(carried, same, "left").select(
        *df.columns,
        *[
            combine(F.col(f"_in_{n}"), F.coalesce(f"_from_{n}", F.lit(0))).alias(n)
            for n in values
        ],
    )


def ordered_turns(
    conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str
) -> DataFrame:
    """(conv, place, t1, t2, chars): the turns of every conversation from place 1, as hashes."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.length(text).cast("bigint").alias("chars"),
    )
    return dense_ordinals(turns, ["conv"], ["turn", "role", "t1", "t2"], "place").drop("turn", "role")


def rebuilt(turns: DataFrame, convs: DataFrame, every: int, heads: int) -> DataFrame:
    """(conv, depth, x1, x2, chars): the first turns of each conversation's base, then its own.

    The base is the conversation at the last multiple of ``every``; crc32 of the number
    modulo ``heads`` says how many turns come from there.
    """
    base = (
        turns.filter((F.col("conv") % every == 0) & (F.col("place") < heads))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "chars"))).alias("head"))
    )  # fewer than ``heads`` turns in a row
    plan = stored(
        convs.withColumns(
            {
                "base": F.col("conv") - F.col("conv") % every,
                "h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads,
            }
        )
        .join(base, "base", "left")
        .select(
            "conv",
            "h",
            F.slice(F.coalesce("head", F.array().cast(base.schema["head"].dataType)), 1, F.col("h").cast("int"))
            .alias("head"),
        ),
        "conversation-heads",
    )
    first = plan.select("conv", F.posexplode("head").alias("at", "turn")).select(
        "conv", (F.col("at") + 1).cast("bigint").alias("depth"), "turn.t1", "turn.t2", "turn.chars"
    )
    own = (
        turns.join(plan.select("conv", "h", F.size("head").alias("taken")), "conv")
        .filter(F.col("place") > F.col("h"))
        .select(
            "conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "chars"
        )
    )
    return first.unionByName(own).select(
        "conv",
        "depth",
        F.xxhash64("depth", "t1", "t2").alias("x1"),
        F.xxhash64("t2", "depth", "t1").alias("x2"),
        "chars",
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): SHA-256 of the numbers that end at each key, in order.

    The numbers are packed in chunks before they meet; a task feeds a key's chunks to
    one hash after the other and holds one chunk.  SHA-256 cannot be split further.
    """
    chunks = (
        ends.select(*KEY, "conv")
        .repartitionByRange(*KEY, "conv")
        .sortWithinPartitions(*KEY, "conv")
        .withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
        .groupBy(*KEY, "chunk")
        .agg(F.sort_array(F.collect_list("conv")).alias("convs"))  # 2^CHUNK_BITS at most
        .select(
            *KEY,
            F.col("convs")[0].alias("first"),
            F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("text"),
        )
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def rows(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[*KEY, "ends_sha256"],
            )

        for batch in batches:
            done = []
            for *this, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield rows(done)
        if key is not None:
            yield rows([(*key, digest.hexdigest())])

    return (
        chunks.repartition(*KEY)
        .sortWithinPartitions(*KEY, "first")
        .mapInArrow(hashed, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    )


# --- centroid decomposition -------------------------------------------------------------
def decomposed(
    parents: list[int], weights: list[int], values: list[tuple[int, int]]
) -> list[tuple[int, int]]:
    """Subtree sums of a forest, parents listed before children (-1: none), by its centroids.

    ``weights`` are subtree weights: positive, larger than those of all children together.
    """
    weights, sums = list(weights), [[0, 0] for _ in parents]
    trees: dict[int, list[int]] = {}
    top: list[int] = []
    for v, parent in enumerate(parents):
        top.append(v if parent < 0 else top[parent])
        trees.setdefault(top[v], []).append(v)
    open_ = list(trees.values())
    while open_:
        part = open_.pop()
        total = weights[part[0]]
        way = [v for v in part if 2 * weights[v] > total]
        centroid = way[-1]
        below: dict[int, int] = {centroid: centroid}
        parts: dict[int, list[int]] = {}
        above, found = [], [0, 0]
        for v in part:
            if v == centroid:
                at = v
            elif (under := below.get(parents[v])) is not None:
                at = below[v] = v if under == centroid else under
                parts.setdefault(at, []).append(v)
            else:
                above.append(v)
                continue
            found[0] += values[v][0]
            found[1] += values[v][1]
        for v in way:
            sums[v][0] += found[0]
            sums[v][1] += found[1]
            weights[v] -= weights[centroid] if v != centroid else 0
        open_ += parts.values()
        if above:
            open_.append(above)
    return [tuple(s) for s in sums]


STATE = (
    "c bigint, m bigint, pc bigint, pm bigint, bottom bigint, weight bigint, leaves bigint, "
    "saved bigint, tc bigint, tm bigint, total bigint, all_leaves bigint, all_saved bigint"
)


def finished(state: DataFrame) -> DataFrame:
    """(c, m, all_leaves, all_saved) of components small enough for a task."""

    def solved(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["tc"], r["tm"], r["bottom"]))
        place = {(r["c"], r["m"]): i for i, r in enumerate(rows)}
        top = [(r["tc"], r["tm"]) for r in rows]
        parents = []
        for r in rows:
            at = place.get((r["pc"], r["pm"]), -1)
            parents.append(at if at >= 0 and top[at] == (r["tc"], r["tm"]) else -1)
        sums = decomposed(
            parents, [r["weight"] for r in rows], [(r["leaves"], r["saved"]) for r in rows]
        )
        return pa.table(
            {
                "c": pa.array([r["c"] for r in rows], pa.int64()),
                "m": pa.array([r["m"] for r in rows], pa.int64()),
                "all_leaves": pa.array(
                    [r["all_leaves"] + s[0] for r, s in zip(rows, sums, strict=True)], pa.int64()
                ),
                "all_saved": pa.array(
                    [r["all_saved"] + s[1] for r, s in zip(rows, sums, strict=True)], pa.int64()
                ),
            }
        )

    buckets = state.count() // BUCKET + 1
    return (
        state.withColumn("bucket", F.pmod(F.xxhash64("tc", "tm"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(
            lambda key, table: solved(table), "c bigint, m bigint, all_leaves bigint, all_saved bigint"
        )
    )


def split_round(state: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over large components: (the results of their centroids, all other vertices)."""
    centroids = (
        state.filter("2 * weight > total")
        .groupBy("tc", "tm")
        .agg(F.min_by(F.struct("c", "m", "bottom", "weight"), "weight").alias("at"))
        .toDF("_tc", "_tm", "at")
    )
    is_centroid = (F.col("c") == F.col("at.c")) & (F.col("m") == F.col("at.m"))
    here = state.join(centroids, (F.col("tc") == F.col("_tc")) & (F.col("tm") == F.col("_tm")))
    is_under = F.col("_owner").isNotNull()
    placed = stored(
        here.join(
            tops,
            (F.col("c") == F.col("_owner"))
            & (F.col("at.bottom") + 1 == F.col("_depth"))
            & (F.col("at.c") == F.col("_pc"))
            & (F.col("at.m") == F.col("_pm"))
            & (F.col("bottom") > F.col("at.bottom")),
            "left",
        ).select(
            *state.columns,
            F.col("at.weight").alias("cut"),
            F.when(is_centroid, "centroid").when(is_under, "below").otherwise("above").alias("side"),
            F.coalesce("_c", "tc").alias("nc"),
            F.coalesce("_m", "tm").alias("nm"),
        ),
        "placed",
    )
    parts = stored(
        placed.filter("side <> 'above'")
        .groupBy("tc", "tm", "nc", "nm", "side")
        .agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("weight").alias("w")
        ),
        "parts",
    )
    found = parts.groupBy(F.col("tc").alias("_tc"), F.col("tm").alias("_tm")).agg(
        F.sum("leaves").alias("f_leaves"), F.sum("saved").alias("f_saved")
    )
    known = placed.join(found, (F.col("tc") == F.col("_tc")) & (F.col("tm") == F.col("_tm")))
    on_way = F.expr("2 * weight > total AND side <> 'below'")
    summed = known.withColumns(
        {
            "all_leaves": F.col("all_leaves") + F.when(on_way, F.col("f_leaves")).otherwise(0),
            "all_saved": F.col("all_saved") + F.when(on_way, F.col("f_saved")).otherwise(0),
        }
    )
    results = summed.filter("side = 'centroid'").select("c", "m", "all_leaves", "all_saved")
    above = summed.filter("side = 'above'").withColumns(
        {
            "weight": F.col("weight") - F.when(on_way, F.col("cut")).otherwise(0),
            "total": F.col("total") - F.col("cut"),
        }
    )
    sizes = parts.filter("side = 'below'").select(
        F.col("nc").alias("_nc"), F.col("nm").alias("_nm"), F.col("w").alias("_total")
    )
    below = placed.filter("side = 'below'").join(
        sizes, (F.col("nc") == F.col("_nc")) & (F.col("nm") == F.col("_nm"))
    ).withColumns({"tc": F.col("nc"), "tm": F.col("nm"), "total": F.col("_total")})
    rest = above.select(*state.columns).unionByName(below.select(*state.columns))
    return results, rest


def rolled_up(vertices: DataFrame, tops: DataFrame) -> DataFrame:
    """(c, m, all_leaves, all_saved): sums over the subtree of every vertex."""
    spark = vertices.sparkSession
    state = stored(vertices, "decomposition")
    results = spark.createDataFrame([], "c bigint, m bigint, all_leaves bigint, all_saved bigint")
    small = []
    while True:
        small.append(state.filter(F.col("total") <= SMALL))
        large = state.filter(F.col("total") > SMALL)
        if not large.limit(1).count():
            break
        done, rest = split_round(large, tops)
        results = results.unionByName(done)
        state = stored(rest, "decomposition")
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    return results.unionByName(finished(rest))


# --- the trie ------------------------------------------------------------------------------
def trie(
    conversations: DataFrame,
    every: int = 100,
    heads: int = 6,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Conversation c is rebuilt from the first h turns of
    conversation c - c % ``every`` (fewer if it has fewer) and its own turns after the
    first h, with h = crc32 of its number modulo ``heads``.

    Turns go by turn (null first), then role, then a hash of the text; repeated rows are
    turns of their own.  Null role or text counts as empty.  Rows without conversation are
    left out; no conversation, no row.  A conversation rebuilt without turns belongs
    to the root only.  Columns not named are not read.
    """
    turns = stored(ordered_turns(conversations, conv_col, turn_col, role_col, text_col), "turns")
    convs = turns.select("conv").distinct()
    rows = stored(rebuilt(turns, convs, every, heads), "rebuilt")
    whole = rows.groupBy("conv").agg(
        F.max("depth").alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2")
    )
    zero = F.lit(0).cast("bigint")
    ends = stored(
        convs.join(whole, "conv", "left").select(
            "conv", *[F.coalesce(F.col(k).cast("bigint"), zero).alias(k) for k in KEY]
        ),
        "ends",
    )
    sequences = stored(
        ends.groupBy(*KEY).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "sequences",
    )
    paths = stored(_paths(rows, sequences), "paths")
    nodes = stored(_nodes(paths, sequences), "nodes")
    linked = stored(_linked(nodes), "linked")
    vertices = stored(_vertices(linked), "vertices")
    tops = stored(_tops(paths, linked, vertices), "tops")
    sums = stored(
        rolled_up(vertices.select(*[c.split()[0] for c in STATE.split(", ")]), tops).select(
            F.col("c").alias("conv_id"), F.col("m").alias("n_convs"), "all_leaves", "all_saved"
        ),
        "rolled-up",
    )
    upto = running(linked, ["conv_id", "n_convs"], "depth", {"upto": "saved"}, F.sum, lambda a, b: a + b)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        upto.join(sums, ["conv_id", "n_convs"])
        .join(stored(ends_digests(ends), "ends-digests"), KEY, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("all_leaves").alias("n_leaves"),
            (F.col("all_saved") - F.col("upto") + F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def _paths(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """(conv, copies, depth, p1, p2, q1, q2, chars): the prefixes of one conversation per sequence."""
    chosen = sequences.select(F.col("rep").alias("conv"), "copies")
    return running(
        rows.join(chosen, "conv"),
        ["conv"],
        "depth",
        {"p1": "x1", "p2": "x2"},
        F.bit_xor,
        lambda a, b: a.bitwiseXOR(b),
    ).select(
        "conv",
        "copies",
        *KEY,
        F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"),
        "chars",
    )


def _nodes(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per key: owner, members, sequences, children, whether a sequence ends there, saved."""
    inner = paths.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"),
        F.sum("copies").alias("n_convs"),
        F.count(F.lit(1)).alias("n_seqs"),
        F.max("chars").alias("chars"),
        F.max("q1").alias("q1"),
        F.max("q2").alias("q2"),
    )
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    root = sequences.agg(
        F.min("rep").alias("conv_id"),
        F.sum("copies").alias("n_convs"),
        F.count(F.lit(1)).alias("n_seqs"),
    ).filter("n_seqs > 0").select(
        *[zero.alias(k) for k in KEY], "conv_id", "n_convs", "n_seqs",
        zero.alias("chars"), none.alias("q1"), none.alias("q2"),
    )
    children = inner.groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    ended = sequences.select(*KEY, F.lit(True).alias("ended"))
    return (
        inner.unionByName(root)
        .join(children, KEY, "left")
        .join(ended, KEY, "left")
        .withColumns(
            {
                "n_children": F.coalesce("n_children", zero),
                "ended": F.coalesce("ended", F.lit(False)),
                "saved": (F.col("n_convs") - 1) * F.col("chars"),
            }
        )
    )


def _linked(nodes: DataFrame) -> DataFrame:
    """The nodes with owner and members of their parents."""
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("q1"),
        F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_convs").alias("parent_n_convs"),
    )
    return nodes.join(above, ["depth", "q1", "q2"], "left")


def _vertices(linked: DataFrame) -> DataFrame:
    """Chains of one member set as one vertex, all in one component under the root."""
    chains = linked.groupBy(F.col("conv_id").alias("c"), F.col("n_convs").alias("m")).agg(
        F.min_by(F.struct("parent_conv_id", "parent_n_convs"), "depth").alias("parent"),
        F.min("depth").alias("top"),
        F.max("depth").alias("bottom"),
        (2 * F.max("n_seqs") - 1).alias("weight"),
        F.max_by("n_children", "depth").alias("below"),
        F.sum("saved").alias("saved"),
    )
    whole = linked.filter("depth = 0").select(
        F.col("conv_id").alias("tc"), F.col("n_convs").alias("tm"), (2 * F.col("n_seqs") - 1).alias("total")
    )
    zero = F.lit(0).cast("bigint")
    return chains.join(F.broadcast(whole)).select(  # one row: the root
        "c",
        "m",
        F.col("parent.parent_conv_id").alias("pc"),
        F.col("parent.parent_n_convs").alias("pm"),
        "top",
        "bottom",
        "weight",
        (F.col("below") == 0).cast("bigint").alias("leaves"),
        "saved",
        "tc",
        "tm",
        "total",
        zero.alias("all_leaves"),
        zero.alias("all_saved"),
    )


def _tops(paths: DataFrame, linked: DataFrame, vertices: DataFrame) -> DataFrame:
    """(_owner, _depth, _c, _m, _pc, _pm): where on a conversation's way each vertex begins."""
    begins = linked.join(
        vertices.select(
            F.col("c").alias("conv_id"), F.col("m").alias("n_convs"), F.col("top").alias("depth"), "pc", "pm"
        ),
        ["conv_id", "n_convs", "depth"],
    ).select(*KEY, F.col("conv_id").alias("_c"), F.col("n_convs").alias("_m"), "pc", "pm")
    return paths.select("conv", *KEY).join(begins, KEY).select(
        F.col("conv").alias("_owner"),
        F.col("depth").alias("_depth"),
        "_c",
        "_m",
        F.col("pc").alias("_pc"),
        F.col("pm").alias("_pm"),
    )
