"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words.  Among all rates (expected copies) of its
documents that meet the target, those nearest to one copy each in relative entropy
are ``min(cap, exp(tilt * size))``; the tilt of each source solves a convex dual,
found by Newton steps over all sources at once.  The rates depend on source and size
only, so the steps run over a histogram of (source, size) and read no document again.

Rates are rounded into copies along the sizes of a source, from the largest: the
copies of every prefix differ from the sum of rates by half a copy at most.  What
is then missing or over is moved within one size of each power of two, again from
the largest.  Which documents of a size get the further copy is decided by a hash
of the id.  All sums are of whole numbers, so every run gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import stored, text_or_empty
from legajo.operators.scaling import dense_ordinals

WORD = r"[^\x20\x09-\x0D]+"
#: Rates are whole multiples of one in this many.
UNIT = 1 << 20


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")


def source_sizes(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))


def source_targets(
    sources: DataFrame, weights: Sequence[float], share: float, cap: float
) -> DataFrame:
    """(source, source_size, target) of the stored (source, source_size).

    Sources by code point, null last, take the weights in turn and divide ``share``
    times all sizes; what lies over ``cap`` times a source's size goes to the others
    by weight until none is over.
    """
    place = dense_ordinals(
        sources.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_place"
    )
    turn = (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    weighed = stored(
        place.select("source", "source_size", weight.alias("weight")), "weighed-sources"
    )
    limit = F.col("source_size") * cap
    level, full = 0.0, -1
    while True:
        over = F.lit(False) if full < 0 else limit < F.col("weight") * level
        now = weighed.agg(
            F.count_if(over).alias("full"),
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
        ).first()
        if now["full"] == full or not now["free"]:
            break
        full, level = now["full"], max(0.0, now["all"] * share - now["held"] * cap) / now["free"]
    return weighed.select(
        "source", "source_size", F.least(limit, F.col("weight") * level).alias("target")
    )


def rate_units(cap: int) -> Column:
    """The rate of (size, mean, tilt) in units; a null tilt stands for the cap."""
    exponent = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(log(cap)))
    return F.when(F.col("tilt").isNull(), F.lit(cap * UNIT)).otherwise(
        F.round(F.exp(exponent) * UNIT).cast("bigint")
    )


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def tilts(histogram: DataFrame, targets: DataFrame, cap: int, rounds: int = 60) -> DataFrame:
    """(source, mean, tilt): the solution of each source's dual.

    A source whose target is ``cap`` times its size has a null tilt: all its rates
    are the cap.  Newton steps stay inside the bracket found so far, and halve it
    where they would leave it.
    """
    scale = histogram.groupBy(F.col("source").alias("_source")).agg(
        F.try_divide(
            F.sum(big("size") * big("size") * big("n")).cast("double"),
            F.sum(big("size") * big("n")).cast("double"),
        ).alias("mean")
    )
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    none = F.lit(None).cast("double")
    state = stored(
        targets.join(scale, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source",
            "target",
            F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"),
            F.when(full, none).otherwise(0.0).alias("tilt"),
            none.alias("low"),
            none.alias("high"),
            full.alias("done"),
        ),
        "tilts",
    )
    for _ in range(rounds):
        if not state.filter("not done").limit(1).count():
            break
        open_ = state.filter("not done").select(F.col("source").alias("_source"), "mean", "tilt")
        rated = histogram.join(open_, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
            "units", rate_units(cap)
        )
        sums = rated.groupBy(F.col("source").alias("_source")).agg(
            (F.sum(big("size") * big("n") * F.col("units").cast("decimal(10,0)")).cast("double") / UNIT)
            .alias("got"),
            F.sum(
                F.when(
                    F.col("units") < cap * UNIT,
                    big(F.col("size") * F.col("n"))
                    * (F.col("size").cast("decimal(9,0)") * F.col("units").cast("decimal(10,0)")),
                )
            ).cast("double").alias("slope"),
        )
        state = stored(_stepped(state, sums), "tilts")
    return state.select("source", "mean", "tilt")


def _stepped(state: DataFrame, sums: DataFrame) -> DataFrame:
    """One Newton step of every open source."""
    tilt, gap = F.col("tilt"), F.col("got") - F.col("target")
    low = F.when(gap < 0, tilt).otherwise(F.col("low"))
    high = F.when(gap > 0, tilt).otherwise(F.col("high"))
    newton = tilt - F.try_divide(gap * F.col("mean") * UNIT, F.col("slope"))
    outwards = F.when(gap < 0, tilt + F.abs(tilt) + 1).otherwise(tilt - F.abs(tilt) - 1)
    lower, upper = F.coalesce("_low", outwards), F.coalesce("_high", outwards)
    fits = (newton > lower) & (newton < upper)
    middle = F.coalesce((F.col("_low") + F.col("_high")) / 2, outwards)
    near = F.abs(gap) <= F.greatest(F.lit(0.25), F.col("target") * 1e-6)
    tight = F.col("_high") - F.col("_low") < 1e-13 * (1 + F.abs(tilt))
    return (
        state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumns({"_low": low, "_high": high})
        .select(
            "source",
            "target",
            "mean",
            F.when(F.col("done") | near, tilt)
            .otherwise(F.when(fits, newton).otherwise(middle))
            .alias("tilt"),
            F.col("_low").alias("low"),
            F.col("_high").alias("high"),
            (F.col("done") | F.coalesce(near, F.lit(False)) | F.coalesce(tight, F.lit(False)))
            .alias("done"),
        )
    )


def group_copies(rates: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(source, size, n, copies): the copies all n documents of a size take together.

    ``rates`` has (source, size, n, units).
    """
    cut = rates.withColumns(
        {"step": F.length(F.bin("size")), "want": F.col("n") * F.col("units")}
    )
    above = Window.partitionBy("source").orderBy(F.desc("step")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    steps = cut.groupBy("source", "step").agg(F.sum("want").alias("want")).select(
        F.col("source").alias("_source"),
        F.col("step").alias("_step"),
        F.coalesce(F.sum("want").over(above), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "step").orderBy(F.desc("size"))
    upto = F.sum("want").over(inside) + F.col("before")
    whole = cut.join(
        steps, F.col("source").eqNullSafe(F.col("_source")) & (F.col("step") == F.col("_step"))
    ).withColumn("upto", upto)
    half = F.lit(UNIT // 2)
    rounded = stored(
        whole.select(
            "source",
            "size",
            "n",
            "step",
            (
                F.shiftright(F.col("upto") + half, 20)
                - F.shiftright(F.col("upto") - F.col("want") + half, 20)
            ).alias("copies"),
        ),
        "rounded",
    )
    return rounded.join(
        _moves(rounded, targets, cap),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")),
        "left",
    ).select(
        "source", "size", "n", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies")
    )


def _moves(rounded: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(_source, _size, move): copies added at the most frequent size of each power of two."""
    taken = rounded.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken")
    )
    rest = targets.join(taken, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source", (F.round("target").cast("bigint") - F.col("taken")).alias("rest")
    )
    one = F.struct("size", "n", "copies")
    chosen = (
        rounded.filter("size > 0")
        .groupBy("source", "step")
        .agg(F.max_by(one, F.struct("n", "size")).alias("one"))
        .groupBy("source")
        .agg(F.sort_array(F.collect_list("one"), asc=False).alias("ones"))  # 63 at most
    )
    start = F.struct(
        F.col("rest").alias("rest"),
        F.array().cast("array<struct<_size:bigint,move:bigint>>").alias("moves"),
    )

    def moved(held: Column, at: Column) -> Column:
        wish = F.round(held["rest"] / at["size"]).cast("bigint")
        move = F.greatest(-at["copies"], F.least(at["n"] * cap - at["copies"], wish))
        return F.struct(
            (held["rest"] - move * at["size"]).alias("rest"),
            F.array_append(
                held["moves"], F.struct(at["size"].alias("_size"), move.alias("move"))
            ).alias("moves"),
        )

    folded = chosen.join(rest, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source", F.aggregate("ones", start, moved)["moves"].alias("moves")
    )
    return folded.select("_source", F.inline("moves"))


def decided(
    docs: DataFrame,
    weights: Sequence[float],
    share: float,
    cap: int,
    id_col: str,
    text_col: str,
    source_col: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, copies), and with ``carry`` the struct ``row``."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            *carried,
        ),
        "sizes",
    )
    histogram = stored(
        rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-histogram"
    )
    sources = stored(source_sizes(histogram), "source-sizes")
    targets = stored(source_targets(sources, weights, share, cap), "targets")
    solved = tilts(histogram, targets, cap).withColumnRenamed("source", "_source")
    rates = histogram.join(solved, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "size", "n", rate_units(cap).alias("units")
    )
    goals = targets.select(F.col("source").alias("_of"), "source_size", "target")
    shares = stored(
        group_copies(rates, targets, cap)
        .join(goals, F.col("source").eqNullSafe(F.col("_of")))
        .select(
            F.col("source").alias("_source"),
            F.col("size").alias("_size"),
            "source_size",
            "target",
            F.when(F.col("size") > 0, F.expr("copies div n")).otherwise(1).alias("each"),
            F.when(F.col("size") > 0, F.expr("copies % n")).otherwise(0).alias("more"),
        ),
        "shares",
    )
    dealt = rows.join(
        shares, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    ).drop("_source", "_size")
    # the row number only splits rows of one id, which are alike in all that counts
    mixed = dealt.filter("more > 0").withColumns(
        {"_hash": F.xxhash64("id"), "_at": F.monotonically_increasing_id()}
    )
    ranked = dense_ordinals(mixed, ["source", "size"], ["_hash", "id", "_at"], "_rank")
    further = (F.col("_rank") <= F.col("more")).cast("int")
    every = dealt.filter("more = 0").withColumn("copies", F.col("each")).unionByName(
        ranked.withColumn("copies", F.col("each") + further).drop("_hash", "_at", "_rank")
    )
    return every.withColumn("copies", F.col("copies").cast("int")).drop("each", "more")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies.

    ``size`` is the number of words (runs without ASCII white space; 0 for a null or
    empty text), ``copies`` how often the mix takes the document, from 0 to ``cap``,
    and ``taken`` copies times size.  A null source is a source, the last one.  A text
    without words is taken once and counts nothing.  Rows that repeat an id are
    documents of their own.  No row in, no row out.  Other columns are not read, so
    their names cannot clash.

    A source comes near its target as far as whole documents allow: within half of its
    shortest text where short texts are left to move.
    """
    rows = decided(docs, weights, share, cap, id_col, text_col, source_col)
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def mixed_rows(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of docs, all columns as they were, once for each copy."""
    rows = decided(docs, weights, share, cap, id_col, text_col, source_col, docs.columns)
    return (
        rows.filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"))
        .select("row.*")
    )
