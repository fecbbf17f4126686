"""Routes, staged names and final folder names.  Plans only; no file is moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import (
    DEFAULT_TASK_MODEL,
    EXTENSION_ROUTES,
    FILE_TYPE_ALIASES,
    ORGANISER_ROUTES,
    ROUTE_LABELS,
    SHORT_TYPE_ALIASES,
    SUPPORTED_EXTENSIONS,
    TASK_MODELS,
    TYPE_ROUTES,
    UNKNOWN_FOLDER,
)
from legajo.functions.text import (
    ColumnLike,
    as_column,
    extension,
    file_name,
    is_blank,
    lookup,
    safe_name,
    stem,
)
from legajo.operators.scaling import dense_ordinals, ordinals

SUBNUMBERED = "guias_y_facturas"
UNSAFE = r'[<>:"/\\|?*]'


# --- routes ---------------------------------------------------------------------
def is_scanned(text: Column, n_tables: Column) -> Column:
    """Little text and no table, or more than 30 % of the characters are symbols."""
    symbols = F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", ""))
    size = F.length(text)
    short = (F.coalesce(size, F.lit(0)) < 100) & (n_tables == 0)
    return short | F.coalesce(F.try_divide(symbols, size) > 0.3, F.lit(False))


def extraction_route(kind: ColumnLike, name: ColumnLike, scanned: Column) -> Column:
    """By document type, else by extension; PDFs by whether they look scanned."""
    by_extension = lookup(EXTENSION_ROUTES, extension(name), "ocr_text")
    pdf_route = F.when(scanned, F.lit("direct_ai")).otherwise(F.lit("ocr_text"))
    return F.coalesce(
        lookup(TYPE_ROUTES, kind),
        F.when(by_extension == "auto", pdf_route).otherwise(by_extension),
    )


def organiser_route(name: ColumnLike) -> Column:
    return lookup(ORGANISER_ROUTES, extension(name), "ocr_text")


def task_model(task: Column, route: Column) -> Column:
    result = F.lit(DEFAULT_TASK_MODEL)
    for (known_task, known_route), model in TASK_MODELS.items():
        same = task == known_task
        if known_route == "direct_ai":
            same = same & (route == "direct_ai")
        elif known_route == "ocr_text":
            same = same & (route != "direct_ai")
        result = F.when(same, F.lit(model)).otherwise(result)
    return result


def is_supported(path: ColumnLike, profile: str = "organiser") -> Column:
    return extension(file_name(path)).isin(SUPPORTED_EXTENSIONS[profile])


# --- aliases ----------------------------------------------------------------------
def canonical_type(alias: ColumnLike) -> Column:
    return lookup({**FILE_TYPE_ALIASES, **SHORT_TYPE_ALIASES}, alias)


def short_alias(kind: ColumnLike) -> Column:
    return lookup({v: k for k, v in SHORT_TYPE_ALIASES.items()}, kind)


def file_alias(kind: ColumnLike) -> Column:
    """Upper-case alias used in file names, else the type itself."""
    column = as_column(kind)
    aliases = {v: k for k, v in FILE_TYPE_ALIASES.items()}
    return F.coalesce(lookup(aliases, column), column)


# --- staging -----------------------------------------------------------------------
def staged_part(name: ColumnLike, size: int | None = None) -> Column:
    """A name made safe for files, whole unless a size is given."""
    safe = F.regexp_replace(as_column(name), UNSAFE, "_")
    part = F.regexp_replace(safe, r"(?U)\s+", "_")
    return part if size is None else F.substring(part, 1, size)


def staging_plan(
    files: DataFrame, batch: str = "batch", name: str = "filename"
) -> DataFrame:
    """Number the files of each batch by name and build their staged names.

    Needs ``document_type``.  Invoices and waybills get a running sub-number.
    Both numbers come from ``dense_ordinals``, so one huge batch is no hot task.
    """
    placed = dense_ordinals(files, [batch], [name], "position")
    numbered = placed.filter(F.col("document_type") == SUBNUMBERED)
    rest = placed.filter(~F.col("document_type").eqNullSafe(SUBNUMBERED))
    both = dense_ordinals(numbered, [batch], ["position"], "sub_number").unionByName(
        rest.withColumn("sub_number", F.lit(None).cast("long"))
    )
    label = lookup(ROUTE_LABELS, organiser_route(name), "UNK")
    position = F.col("position").cast("string")
    padded = F.when(F.col("position") < 1000, F.lpad(position, 3, "0")).otherwise(position)
    suffix = F.regexp_extract(F.col(name), r"[^/](\.[^./]+)$", 1)
    return both.withColumns(
        {
            "display_type": F.concat_ws("_", "document_type", "sub_number"),
            "staged_name": F.concat(
                F.concat_ws(
                    "__", padded, file_alias("document_type"), label,
                    staged_part(stem(name)),
                ),
                suffix,
            ),
        }
    )


# --- final folders ------------------------------------------------------------------
def folder_name(
    insured: ColumnLike, claim: ColumnLike, stamp: Column, limit: int | None = None
) -> Column:
    """`<INSURED> - <claim>`; a stamp replaces a missing claim.

    With a limit the insured is shortened so that the name fits; the claim stays whole.
    """
    insured, claim = as_column(insured), as_column(claim)
    squeezed = F.trim(F.regexp_replace(F.regexp_replace(insured, UNSAFE, ""), r"(?U)\s+", " "))
    who = F.when(is_blank(insured), F.lit(UNKNOWN_FOLDER)).otherwise(
        F.upper(squeezed)
    )
    digits = F.regexp_replace(claim, r"\D", "")
    number = (
        F.when(is_blank(claim), stamp)
        .when(F.length(digits) == 14, digits)
        .otherwise(F.regexp_replace(claim, UNSAFE, ""))
    )
    if limit is None:
        return F.concat(who, F.lit(" - "), number)
    room = F.greatest(F.lit(limit) - F.length(number) - 3, F.lit(0))
    return F.concat(F.substring(who, F.lit(1), room), F.lit(" - "), number)


def resolve_collisions(
    folders: DataFrame, existing: DataFrame, order: Sequence[str], name: str = "folder"
) -> DataFrame:
    """Give each wanted folder the first free of name, name_2, name_3 ...

    The n-th folder of a name takes its n-th free suffix.  Taken suffixes of a
    name come from ``existing``; free number = n shifted past every taken one at
    or below it, which one sorted pass over the few taken suffixes gives.
    """
    parts = existing.select(
        F.regexp_replace(name, r"_([2-9]|[1-9]\d+)$", "").alias("_base"),
        F.coalesce(
            F.regexp_extract(name, r"_([2-9]|[1-9]\d+)$", 1).try_cast("int"), F.lit(1)
        ).alias("_taken"),
        F.col(name).alias("_whole"),
    )
    taken = (
        parts.select("_base", "_taken")
        .union(parts.select("_whole", F.lit(1)))
        .groupBy("_base")
        .agg(F.array_sort(F.collect_set("_taken")).alias("_taken"))
    )
    ranked = ordinals(folders, [name], order, "_n")
    shift = F.aggregate(
        F.coalesce("_taken", F.array().cast("array<int>")),
        F.col("_n"),
        lambda acc, t: F.when(t <= acc, acc + 1).otherwise(acc),
    )
    joined = ranked.join(taken, ranked[name] == taken["_base"], "left").withColumn("_slot", shift)
    unique = F.when(F.col("_slot") == 1, F.col(name)).otherwise(
        F.concat(F.col(name), F.lit("_"), F.col("_slot"))
    )
    return joined.withColumn("final_folder", unique).select(*folders.columns, "final_folder")


def reorganised_path(insured: ColumnLike, claim: ColumnLike, document_path: ColumnLike) -> Column:
    """`<insured> - <claim>/<stem>/ocr_results_for_<name>.json`, each part made safe."""
    return F.concat(
        safe_name(insured), F.lit(" - "), safe_name(claim), F.lit("/"),
        safe_name(stem(document_path)), F.lit("/ocr_results_for_"),
        safe_name(file_name(document_path)), F.lit(".json"),
    )


def report_name(insured: ColumnLike, claim: ColumnLike, ending: str = "_INFORME.html") -> Column:
    return F.concat(safe_name(insured), F.lit("_"), safe_name(claim), F.lit(ending))
