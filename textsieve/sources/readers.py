"""Sources: rule folders, event lines, issue forms, documents by bytes, legacy Korean text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import read_rule_tables  # noqa: F401  (the rule source)

MAX_BYTES, MAX_CONTEXT = 262_144, 1_000_000
#: Folders that no walk goes into.
SKIPPED_FOLDERS = ["node_modules", ".git", "dist", "build", "vendor", "__pycache__"]


def glob_to_regex(glob: str) -> str:
    """**/ for any folders, ** for anything, * within a name."""
    out, i = "", 0
    for m in re.finditer(r"\*\*/|\*\*|\*", glob):
        out += re.escape(glob[i : m.start()]) + {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}[m[0]]
        i = m.end()
    return f"^{out}{re.escape(glob[i:])}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_to_regex(g))
    return hit


def bounded_text(content: Column, limit: int = MAX_BYTES) -> Column:
    """The first limit bytes as text, without a character cut in two; null where the bytes are no UTF-8 text.

    The cut tail is at most three bytes, so one of four cuts is whole.
    """
    head = F.substring(content, 1, limit)
    whole = [F.substring(head, F.lit(1), F.length(head) - k) for k in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(w.cast("string")), w.cast("string")) for w in whole])
    text = F.when(F.length(content) > limit, cut).otherwise(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")))
    return F.when(~text.rlike("[�\\x00]") | (text == ""), text)


def read_documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Rows (path, text) of regular files, bounded; what is no text is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", bounded_text(F.col("content")).alias("text"))


def read_for_context(spark: SparkSession, folder: str, glob: str = "*", limit: int = MAX_CONTEXT) -> DataFrame:
    """Rows (path, text) of whole files; null where a file is longer than limit or no text. Long files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    small = files.where(F.col("length") <= limit).select("path", bounded_text(F.col("content"), limit).alias("text"))
    return small.unionByName(files.where(F.col("length") > limit).select("path", F.lit(None).cast("string").alias("text")))


def outside(paths: DataFrame, folders: list[str] = SKIPPED_FOLDERS, path_col: str = "path") -> DataFrame:
    """paths that lie in none of the folders, at any depth."""
    inner = "|".join(re.escape(f) for f in folders)
    return paths.where(~F.col(path_col).rlike(f"(?:^|/)(?:{inner})/"))


def snapshot(versions: DataFrame, sha: str) -> DataFrame:
    """Rows (path, text) of the files (path, sha, text) as they stood at one version."""
    return versions.where(F.col("sha") == sha).select("path", "text")


def read_legacy_csv(spark: SparkSession, path: str, schema: str, encoding: str = "cp949") -> DataFrame:
    """CSV files with a header line in a legacy Korean encoding; rows of files that are not in it are left out.

    Bytes are decoded in Arrow batches: Spark's own reader takes such an encoding
    only with a setting of the whole session. Fields hold no line breaks.
    """

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def text(b):
            try:
                return bytes(b).decode(encoding)
            except UnicodeDecodeError:
                return None

        for s in batches:
            yield s.map(text)

    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.posexplode(F.split(decoded("content"), "\r?\n", -1)).alias("n", "line")).where("n > 0 AND line <> ''")
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file: an array, or an object whose rules are one."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("rules").alias("r")).select("r.*") if "rules" in df.columns else df
