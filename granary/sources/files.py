"""Folders of files and pages of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.plans.table_plan import PlanError

#: The files that are taken in.
EXTENSIONS = ("pdf", "docx", "xlsx", "xls", "csv", "md", "txt")


def supported(path) -> object:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(list(EXTENSIONS))


#: Folders that are passed over, and how much one folder may hold.
EXCLUDED = (".git", ".svn", ".idea", ".vscode", "node_modules", "$recycle.bin", "system volume information")
MOST_DEPTH, MOST_ENTRIES, MOST_FILES, MOST_BYTES = 32, 20_000, 1_000, 100 << 20
#: States of documents that are being worked on, and of those that failed.
BUSY, FAILED = ("PENDING", "PROCESSING", "VECTORIZING"), ("FAILED", "VECTOR_FAILED")


def list_folder(spark: SparkSession, path: str, most_depth: int = MOST_DEPTH, most_entries: int = MOST_ENTRIES, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, relative_path, source_key, size and reason (null for files to take in) of the supported files below a folder.

    Folders are looked into level by level through the file system's own listing, which works for any store Spark reads. It stops at once when there
    are more than most_entries entries or most_files supported files, or more levels than most_depth; each is an error, so that a folder that can't be
    taken in whole leaves what is stored alone. Excluded folders are not looked into. Contents are not read.
    """
    name = path.rstrip("/").split("/")[-1].replace("'", "''")
    base = f"/{name}/"
    found, entries, files, level = [], 0, 0, 0
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [fs_path]
    while folders:
        if (level := level + 1) > most_depth:
            raise PlanError(f"the folder has more than {most_depth} levels")
        inner, here = [], []
        for folder in folders:  # the frontier: at most most_entries folders and files are ever looked at
            listing = fs.listStatusIterator(folder)
            while listing.hasNext():
                status = listing.next()
                if (entries := entries + 1) > most_entries:
                    raise PlanError(f"the folder has more than {most_entries} entries")
                if status.isDirectory():
                    if status.getPath().getName().lower() not in EXCLUDED:
                        inner.append(status.getPath())
                elif status.isFile():
                    here.append((status.getPath().toString(), status.getLen()))
        folders = inner
        wanted = [(p, n) for p, n in here if p.rsplit(".", 1)[-1].lower() in EXTENSIONS and "." in p.rsplit("/", 1)[-1]]
        if (files := files + len(wanted)) > most_files:
            raise PlanError(f"the folder has more than {most_files} files")
        found += wanted
    rows = spark.createDataFrame(found, "path string, size long")
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(path.rstrip('/').split('/')[-1]) + 2})")
    return rows.select("path", relative.alias("relative_path"), "size", F.when(F.col("size") > most_bytes, "too large").alias("reason")).withColumn("source_key", F.sha2("relative_path", 256))


def scan_folder(spark: SparkSession, path: str, **limits) -> DataFrame:
    """source_key, relative_path, size, fingerprint (SHA-256) and reason of the supported files below a folder; see list_folder(). Only files
    without a reason against them are read, in the cluster."""
    listed = list_folder(spark, path, **limits)
    taken = [r["path"] for r in listed.where("reason is null").select("path").collect()]  # bounded by most_files
    read = spark.read.format("binaryFile").load(taken).select(F.col("path"), F.sha2("content", 256).alias("fingerprint")) if taken else spark.createDataFrame([], "path string, fingerprint string")
    return listed.join(F.broadcast(read), "path", "left").select("source_key", "relative_path", "size", "fingerprint", "reason")


def sync_plan(found: DataFrame, stored: DataFrame) -> DataFrame:
    """source_key, relative_path, change and reason: what a folder's files (source_key, relative_path, fingerprint, reason) mean for the stored documents
    (source_key, relative_path, fingerprint, status): added, updated, unchanged, removed or skipped.

    A file with a reason against it is skipped and keeps its document; a failed document counts as changed; documents that are being
    worked on are left alone until the next time, whether their file changed or went.
    """
    a = found.select("source_key", F.col("relative_path").alias("_path"), F.col("fingerprint").alias("_new"), F.col("reason").alias("_reason"), F.lit(True).alias("_found"))
    b = stored.select("source_key", F.col("relative_path").alias("_was"), F.col("fingerprint").alias("_old"), "status", F.lit(True).alias("_stored"))
    busy, failed = F.coalesce(F.col("status").isin(*BUSY), F.lit(False)), F.coalesce(F.col("status").isin(*FAILED), F.lit(False))
    same = F.col("_new").eqNullSafe(F.col("_old")) & ~failed
    change = (
        F.when(F.col("_reason").isNotNull(), "skipped").when(F.col("_stored").isNull(), "added").when(F.col("_found") & same, "unchanged").when(busy, "skipped").when(F.col("_found").isNull(), "removed").otherwise("updated")
    )
    joined = a.join(b, "source_key", "full_outer").withColumn("change", change)
    reason = F.coalesce("_reason", F.when(F.col("change") == "skipped", "being worked on"))
    return joined.select("source_key", F.coalesce("_path", "_was").alias("relative_path"), "change", reason.alias("reason"))


def text_pages(docs: DataFrame, size: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page and content: slices of `size` characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(size))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.posexplode(starts).alias("page", "_at")).select("doc_id", (F.col("page") + 1).alias("page"), F.substring("_text", F.col("_at"), F.lit(size)).alias("content"))


def read_pages(pages: DataFrame, wanted: list[int], budget: int = 24_000, most: int = 6) -> DataFrame:
    """Of each document the wanted pages, up to `most` and while their characters fit the budget, with next_page."""
    if not wanted or len(wanted) > most:
        raise ValueError(f"one to {most} pages are read at a time")
    running = Window.partitionBy("doc_id").orderBy("page")
    chosen = pages.where(F.col("page").isin(wanted)).withColumn("_sum", F.sum(F.length("content")).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    return chosen.where(F.col("_sum") <= budget).drop("_sum").join(last, "doc_id").withColumn("next_page", F.when(F.col("page") < F.col("_last"), F.col("page") + 1)).drop("_last")


def write_ordered_text(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """session and markdown: the messages of each session in order."""
    one = F.concat(F.lit("## "), F.col(role), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    return messages.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: of each key the row of the greatest version."""
    both = old.unionByName(new)
    row = F.struct(*[F.col(c) for c in both.columns])
    return both.groupBy(key).agg(F.max_by(row, version).alias("_row")).select("_row.*")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors reach. Where that is unset, below the session's warehouse if that was set or
    Spark runs on one machine; else it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir") and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to a shared folder and read again: cuts the lineage of a loop, and outlives executors."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
