"""Folders of text files as tables, and JSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read, and the language tag of source code.
SUFFIXES = ("txt", "md", "py", "js", "json", "csv")
LANGUAGES = {"py": "python", "js": "javascript", "json": "json", "csv": "csv"}


def scan_corpus(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A1: (path, name, size, mtime, text) of the files under ``root``; undecodable bytes are left out.

    Files are listed by Spark, so any store it reads will do; a file must fit one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index("path", "/", -1)
    files = files.where(F.lower(F.substring_index("path", ".", -1)).isin(list(suffixes)))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), text.alias("text"))


def path_identity(path: Column, root: str, default: str = "default") -> Column:
    """A2: struct(source_root, rel_path, rel_dir, domain); ``rel_dir`` is the folder, or ``.``; the domain its last name, or ``default``."""
    rel = F.regexp_replace(F.translate(path, "\\", "/"), "^.*?" + root.strip("/").replace(".", "\\.") + "/", "")
    folder = F.when(F.contains(rel, F.lit("/")), F.regexp_replace(rel, "/[^/]*$", "")).otherwise(".")
    domain = F.when(folder == ".", F.lit(default)).otherwise(F.substring_index(folder, "/", -1))
    return F.struct(F.lit(root).alias("source_root"), rel.alias("rel_path"), folder.alias("rel_dir"), domain.alias("domain"))


def wrap_source_code(name: Column, text: Column) -> Column:
    """A4: the file's name and its text in a fenced block with a language tag."""
    suffix = F.lower(F.substring_index(name, ".", -1))
    tag = F.lit("")
    for s, language in LANGUAGES.items():
        tag = F.when(suffix == s, F.lit(language)).otherwise(tag)
    return F.concat(F.lit("文件: "), name, F.lit("\n```"), tag, F.lit("\n"), text, F.lit("\n```"))


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row under ``path``."""
    df.write.mode("overwrite").json(path)
