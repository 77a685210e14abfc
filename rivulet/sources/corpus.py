"""Files and the questions a document vault answers: tags, counts, files by tags, trees, single files."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import order

#: Most rows a tool returns, and the size and least rows of a cut answer.
DEFAULT_FILES, MOST_FILES, DEFAULT_TAGS, MOST_TAGS = 100, 1000, 500, 5000
ANSWER_BYTES, LEAST_FILES, LEAST_TAGS = 500 * 1024, 20, 50


def from_rows(spark: SparkSession, rows: Sequence, schema: str, position: str = "_ord") -> DataFrame:
    """Driver rows in their order."""
    return spark.createDataFrame([(i, *((r,) if not isinstance(r, (tuple, list)) else r)) for i, r in enumerate(rows)], f"{position} bigint, {schema}")


def discover_files(spark: SparkSession, path: str, pattern: str = "**/*.md") -> DataFrame:
    """(path, name) of the files below ``path`` that match a glob; ``**/`` is any depth, including none."""
    if not path:
        raise ValueError("a path is needed")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", os.path.basename(pattern)).load(path).select("path")
    root = path.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.removeprefix("file:")) + "/", "")
    folder = os.path.dirname(pattern)
    if folder != "**":
        files = files.where(relative.rlike("^" + _glob(pattern) + "$"))
    return files.select(F.concat(F.lit(root + "/"), relative).alias("path"), T.base_name("path").alias("name"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _glob(pattern: str) -> str:
    out = []
    for i, part in enumerate(pattern.split("/")):
        if part == "**":
            out.append("(?:[^/]+/)*")
        else:
            out.append(fnmatch.translate(part).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z").replace(".*", "[^/]*") + "/")
    return "".join(out).removesuffix("/")


def read_files(spark: SparkSession, path: str, pattern: str = "*.md", skip_bad: bool = False) -> DataFrame:
    """(content, source) of whole text files; ``skip_bad`` leaves out missing and unreadable ones."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if skip_bad:
        reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return reader.text(path, wholetext=True).select(F.col("value").alias("content"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("source"))  # paths come percent-encoded


def read_file(spark: SparkSession, path: str) -> DataFrame:
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        raise FileNotFoundError(f"File not found: {path}")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.lit(path).alias("source"))


def extract_files(df: DataFrame, files: str = "files") -> DataFrame:
    return df.select(F.inline(files))


# -- vault questions over (path, tags, modified) rows -----------------------------------


def tag_counts(files: DataFrame) -> DataFrame:
    """(tag, document_count); a tag counts once per file."""
    return files.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("document_count"))


def list_tags(files: DataFrame, least: int = 0, limit: int = DEFAULT_TAGS) -> DataFrame:
    """Tags by falling count, then by name in Unicode collation."""
    if not 0 < limit <= MOST_TAGS:
        raise ValueError(f"limit must be 1 to {MOST_TAGS}")
    counts = tag_counts(files).where(F.col("document_count") >= least)
    return counts.orderBy(F.desc("document_count"), F.expr("tag COLLATE UNICODE"), "tag").limit(limit)


def with_tags(files: DataFrame, tags: Sequence[str], match_all: bool) -> DataFrame:
    wanted = F.transform(F.array(*map(F.lit, tags)), T.normal_tag)
    have = F.transform("tags", T.normal_tag)
    fits = F.size(F.array_intersect(have, wanted)) == F.size(F.array_distinct(wanted)) if match_all else F.arrays_overlap(have, wanted)
    return files.where(fits)


def search_tags(files: DataFrame, tags: Sequence[str], operator: str = "or", limit: int = DEFAULT_FILES) -> DataFrame:
    """Matching files by falling time of change (unknown last), then path, with titles."""
    if operator not in ("and", "or"):
        raise ValueError("operator must be 'and' or 'or'")
    if not tags:
        raise ValueError("tags are needed")
    if not 0 < limit <= MOST_FILES:
        raise ValueError(f"limit must be 1 to {MOST_FILES}")
    found = with_tags(files, tags, operator == "and").withColumn("title", T.title_of("path"))
    return found.orderBy(F.desc_nulls_last("modified"), "path").limit(limit)


def answer(found: DataFrame, order_by, least: int) -> dict:
    """A tool's answer: the rows that fit the size, their status, and whether rows were left out."""
    n = found.count()
    cut = order.halve_to_bytes(found, order_by, ANSWER_BYTES, least)
    rows = [r.asDict(recursive=True) for r in cut.collect()]
    return {"status": "success" if n else "no_matches", "total": n, "rows": rows, "truncated": len(rows) < n}


def folder_tree(files: DataFrame) -> DataFrame:
    """(folder, depth, ext, n): files of each extension directly in each folder."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    name = T.base_name("path")
    ext = F.when(name.rlike(r".\.[^.]+$"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).otherwise("")
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    return files.groupBy(folder.alias("folder"), depth.cast("long").alias("depth"), ext.alias("ext")).agg(F.count("*").alias("n"))


def list_files(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Paths below a folder (all without one); a leading slash is an error."""
    if folder and folder.startswith("/"):
        raise ValueError("folders are given without a leading slash")
    return files.where(F.col("path").startswith(folder.rstrip("/") + "/")) if folder else files


def nested_tree(files: DataFrame, folder: str | None = None, with_names: bool = True) -> dict:
    """The recursive tree {files, sub_folders, extension_counts}, assembled on the driver from folder rows."""
    def empty() -> dict:
        return {"files": [], "sub_folders": {}, "extension_counts": {}}

    def at(folder_path: str) -> dict:
        node = root
        for part in filter(None, folder_path.split("/")):
            node = node["sub_folders"].setdefault(part, empty())
        return node

    root = empty()
    rows = list_files(files, folder)
    for r in folder_tree(rows).orderBy("folder", "ext").toLocalIterator():
        at(r["folder"])["extension_counts"][r["ext"]] = r["n"]
    if with_names:
        for r in rows.select("path").orderBy("path").toLocalIterator():
            head, _, name = r["path"].rpartition("/")
            at(head)["files"].append(name)
    return root


def tree_answer(files: DataFrame, folder: str | None = None) -> dict:
    """{status, tree, truncated}: success, not_found (nothing below the folder) or invalid_path (a leading slash).

    A tree of more than ANSWER_BYTES as JSON comes without file names; the names are
    measured before any of them is brought to the driver.
    """
    if folder and folder.startswith("/"):
        return {"status": "invalid_path", "tree": None, "truncated": False}
    rows = list_files(files, folder)
    names = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length(T.base_name("path")) + 4).alias("size")).first()
    if folder and not names["n"]:
        return {"status": "not_found", "tree": None, "truncated": False}
    tree = nested_tree(files, folder) if (names["size"] or 0) <= ANSWER_BYTES else None
    truncated = tree is None or len(json.dumps(tree, ensure_ascii=False).encode()) > ANSWER_BYTES
    return {"status": "success", "tree": nested_tree(files, folder, with_names=False) if truncated else tree, "truncated": truncated}


def file_at(files: DataFrame, path: str) -> dict:
    """{status, row}: success, not_found or invalid_path."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        return {"status": "invalid_path", "row": None}
    row = files.where(F.col("path") == path).limit(1).collect()
    return {"status": "success", "row": row[0].asDict(recursive=True)} if row else {"status": "not_found", "row": None}
