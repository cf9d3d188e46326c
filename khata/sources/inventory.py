"""File inventories: classification, incremental selection, budgets and period folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Folder names that decide the type of every file below them.
FOLDER_TYPES = {
    "sales invoice": "invoice", "other invoices": "invoice", "credit note": "credit_note",
    "sale analysis": "ignore",
}


def _by_extension(name: Column, purchase: bool) -> Column:
    lower = F.lower(name)
    if purchase:
        return F.when(lower.endswith(".zip"), "archive").when(lower.endswith(".pdf"), "invoice").otherwise("unknown")
    return (
        F.when(lower.endswith(".xlsx") | lower.endswith(".xls"), "client_sheet")
        .when(lower.endswith(".pdf"), "invoice").otherwise("unknown"))


def classify(files: DataFrame, purchase: bool = False) -> DataFrame:
    """Document type per file from its folders (outermost known name wins), then its extension.

    ``path`` is the '/'-separated location below the walked root. Files under an ignored folder are
    dropped, unless a folder above it already fixed their type.
    """
    parts = F.split("path", "/")
    rows = files.select("*", F.element_at(parts, -1).alias("name"),
                        F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"))
    if purchase:
        return rows.withColumn("document_type", _by_extension(F.col("name"), True))
    table = F.create_map(*[F.lit(x) for pair in FOLDER_TYPES.items() for x in pair])
    known = F.array_compact(F.transform("folders", lambda f: F.try_element_at(table, F.lower(F.trim(f)))))
    first = F.try_element_at(known, F.lit(1))
    typed = rows.withColumn(
        "document_type",
        F.when(first.isNotNull(), first).when(F.size("folders") > 0, "unknown")
        .otherwise(_by_extension(F.col("name"), False)))
    return typed.filter("document_type <> 'ignore'")


def histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


def needs_processing(files: DataFrame, tracker: DataFrame) -> DataFrame:
    """New, changed or unfinished files, each marked new or updated."""
    known = tracker.select("file_id", F.col("md5").alias("t_md5"), F.col("status").alias("t_status"),
                           F.lit(True).alias("tracked"))
    joined = files.join(known, "file_id", "left")
    changed = (
        F.col("tracked").isNull() | ~F.col("t_md5").eqNullSafe(F.coalesce("md5", F.lit("")))
        | (F.coalesce("t_status", F.lit("")) != "completed"))
    return joined.filter(changed).select(
        *files.columns, F.when(F.col("tracked"), "updated").otherwise("new").alias("change"))


def within_budget(files: DataFrame, budget: int, order: str) -> DataFrame:
    """The first ``budget`` files in arrival order are taken, the rest is kept as deferred.

    Only the cut-off value is worked out globally, by a top-n; no row number runs over all files.
    ``order`` must be unique.
    """
    first = files.select(F.col(order).alias("_o")).orderBy("_o").limit(budget).agg(F.max("_o").alias("_cut"))
    taken = F.coalesce(F.col(order) <= F.col("_cut"), F.lit(False))
    return files.join(F.broadcast(first), F.lit(True), "left").withColumn("deferred", ~taken).drop("_cut")
