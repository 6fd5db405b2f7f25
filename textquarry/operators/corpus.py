"""Documents as a corpus: statistics, catalogues, change detection, HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx


def document_stats(docs: DataFrame, pages: DataFrame | None = None, headings: DataFrame | None = None) -> DataFrame:
    """Characters without white space, Han characters, words, sentences and paragraphs of each document.

    With ``pages`` (doc_id, page) also ``pages``, the largest; with ``headings`` (doc_id) also ``chapters``,
    their number, null for none. Both combine before their shuffle.
    """
    t = fx.blank("text")
    paragraphs = F.filter(F.split(t, "\n[ \t]*\n", -1), lambda p: F.trim(F.translate(p, "\n", " ")) != "")
    out = docs.select(
        "doc_id",
        F.length(F.regexp_replace(t, "[ \t\r\n]", "")).cast("long").alias("n_chars"),
        F.length(F.regexp_replace(t, "[^\\x{4e00}-\\x{9fff}]", "")).cast("long").alias("n_han"),
        F.size(F.regexp_extract_all(t, F.lit("[^ \t\r\n]+"), F.lit(0))).cast("long").alias("n_words"),
        F.size(fx.sentence_array("text")).cast("long").alias("n_sentences"),
        F.size(paragraphs).cast("long").alias("n_paragraphs"),
    )
    if pages is not None:
        out = out.join(pages.groupBy("doc_id").agg(F.max("page").alias("pages")), "doc_id", "left")
    if headings is not None:
        out = out.join(headings.groupBy("doc_id").agg(F.count("*").alias("chapters")), "doc_id", "left")
    return out


def library_stats(stats: DataFrame, docs: DataFrame, by: str = "lang", ids: str | None = None) -> DataFrame:
    """D3: a row per document (``kind`` document), per format (format) and for the library (library), with totals.

    With ``ids`` only documents whose id contains it count. Chapters belong to documents alone.
    """
    both = stats.join(docs.select("doc_id", F.col(by).alias("format")), "doc_id")
    if ids is not None:
        both = both.where(F.contains(F.col("doc_id").cast("string"), F.lit(ids)))
    sums = [F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"), F.sum("n_sentences").alias("n_sentences")]
    totals = both.rollup("format").agg(*sums, F.grouping("format").alias("all"))
    none = F.lit(None).cast("long").alias("chapters")
    totals = totals.select(F.when(F.col("all") == 1, "library").otherwise("format").alias("kind"), F.lit(None).cast("string").alias("doc_id"), "format", "n_documents", "n_words", "n_sentences", none)
    chapters = F.col("chapters") if "chapters" in both.columns else none
    each = both.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), "format", F.lit(1).cast("long").alias("n_documents"), "n_words", "n_sentences", chapters)
    return each.unionByName(totals)


def file_catalogue(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks, characters, the first chunk, suffix and metadata of each document; ``files`` has doc_id, file_name and more."""
    out = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.md5(F.min_by("chunk", "chunk_index")).alias("first_md5")
    )
    suffix = F.when(F.contains("file_name", F.lit(".")), F.lower(F.substring_index("file_name", ".", -1))).otherwise("")
    return out.join(files.withColumn("suffix", suffix), "doc_id")


def html_to_text(pages: DataFrame, max_lines: int = 300, max_chars: int = 15_000) -> DataFrame:
    """A5: (page_id, title, content): tags dropped, block ends as line ends, four entities, lines of over 5 characters.

    The limits are the feature (a preview); pass larger ones for whole pages.
    """
    t = fx.blank("html")
    title = F.trim(F.regexp_extract(t, "(?is)<title[^>]*>(.*?)</title>", 1))
    for pattern, to in (("(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), ("(?i)</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)>|<br */?>", "\n"), ("<[^>]*>", " ")):
        t = F.regexp_replace(t, pattern, to)
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    rows = F.filter(F.transform(F.split(t, "\n", -1), lambda s: F.trim(F.regexp_replace(s, "[ \t]+", " "))), lambda s: F.length(s) > 5)
    content = F.substring(F.array_join(F.slice(rows, 1, max_lines), "\n"), 1, max_chars)
    return pages.select("page_id", F.when(title != "", title).otherwise("Imported").alias("title"), content.alias("content"))


def corpus_diff(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """(rel_path, name, status) of new, modified (mtime off by over a second, or another size) and deleted files.

    ``disk`` has source_root, rel_path, name, size and mtime; ``indexed`` the same, where older rows lack the
    root, or root and path. A file matches its row by root and path, else by path alone, else by name.
    """
    exact = indexed.where("source_root IS NOT NULL AND rel_path IS NOT NULL")
    by_path = indexed.where("source_root IS NULL AND rel_path IS NOT NULL")
    by_name = indexed.where("rel_path IS NULL")
    facts = F.struct("mtime", "size")
    first = lambda df, *key: df.groupBy(*key).agg(F.min(facts).alias("f"))
    both = disk.join(first(exact, "source_root", "rel_path").withColumnRenamed("f", "f1"), ["source_root", "rel_path"], "left")
    both = both.join(first(by_path, "rel_path").withColumnRenamed("f", "f2"), "rel_path", "left")
    both = both.join(first(by_name, "name").withColumnRenamed("f", "f3"), "name", "left").withColumn("f", F.coalesce("f1", "f2", "f3"))
    status = F.when(F.col("f").isNull(), "new").when((F.abs(F.col("mtime") - F.col("f.mtime")) > 1) | (F.col("size") != F.col("f.size")), "modified")
    changed = both.select("rel_path", "name", status.alias("status")).where("status IS NOT NULL")
    gone = exact.unionByName(by_path).join(disk.select("rel_path"), "rel_path", "left_anti").select("rel_path", "name")
    gone = gone.unionByName(by_name.join(disk.select("name"), "name", "left_anti").select("rel_path", "name"))
    return changed.unionByName(gone.withColumn("status", F.lit("deleted")))


def diff_counts(diff: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: numbers of new, modified and deleted files, of indexed ones, and the latest ``uploaded_at``."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return diff.agg(n("new"), n("modified"), n("deleted")).crossJoin(indexed.agg(F.count("*").alias("total_indexed"), F.max("uploaded_at").alias("last_scan")))


def skip_unchanged(disk: DataFrame, indexed: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Files that are not indexed with just this time and size; of ``targets`` (path) only, where given."""
    files = disk if targets is None else disk.join(targets.select("path"), "path", "left_semi")
    return files.join(indexed.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti").select("path", "size", "mtime")


def cross_document_terms(docs: DataFrame) -> DataFrame:
    """Every term with its number of documents; shared by several, or the only document's."""
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(fx.blank("text")), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("term"))
    n = terms.groupBy("term").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc"))
    return n.select("term", "n_documents", (F.col("n_documents") > 1).alias("shared"), F.when(F.col("n_documents") == 1, F.col("first_doc")).alias("only_doc"))


def markdown_sections(lines: DataFrame) -> DataFrame:
    """A3: sections of numbered lines (doc_id, line_no, line), cut at headings outside code fences."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.ltrim("line").startswith("```")
    marked = lines.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    head = ~F.col("inside") & ~fence & F.col("line").rlike("^#{1,6}[ \t]+[^ \t]")
    marked = marked.withColumn("is_head", head).withColumn("section", F.sum(F.col("is_head").cast("long")).over(w))
    level = F.coalesce(F.max(F.when(F.col("is_head"), F.length(F.regexp_extract("line", "^(#+)", 1)))), F.lit(0))
    title = F.coalesce(F.max(F.when(F.col("is_head"), F.trim(F.regexp_replace("line", "^#+[ \t]+", "")))), F.lit(""))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line"))))
    content = F.array_join(F.transform(body, lambda x: x["line"]), "\n")
    return marked.groupBy("doc_id", "section").agg(level.alias("level"), title.alias("title"), F.md5(content).alias("content_md5"))


def replace_documents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored chunks without those of re-imported documents, and the fresh ones."""
    return stored.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def delete_documents(stored: DataFrame, ids: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks none of whose columns ``by`` (such as physical and file name) is in ``ids`` (id); blank ids are ignored."""
    ids = _ids(ids, stored, by[0])
    for c in by:
        stored = stored.join(ids.withColumnRenamed("id", c), c, "left_anti")
    return stored


def removed_counts(stored: DataFrame, ids: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(id, removed): how many chunks ``delete_documents`` takes away for each id, 0 included."""
    ids = _ids(ids, stored, by[0])
    keys = stored.select(F.explode(F.array_distinct(F.array(*(F.col(c) for c in by)))).alias("id")).groupBy("id").agg(F.count("*").alias("removed"))
    return ids.join(keys, "id", "left").select("id", F.coalesce("removed", F.lit(0)).alias("removed"))


def _ids(ids: DataFrame, stored: DataFrame, like: str) -> DataFrame:
    filled = ids.where(F.trim(F.col("id").cast("string")) != "").select(F.col("id").cast(stored.schema[like].dataType).alias("id"))
    return filled.distinct()


def delete_domain(stored: DataFrame, domain: str) -> DataFrame:
    """Everything outside the domain."""
    return stored.where(~F.col("domain").eqNullSafe(F.lit(domain)))


def domain_files(stored: DataFrame) -> DataFrame:
    """(domain, n_files): how many files ``delete_domain`` would remove."""
    return stored.groupBy("domain").agg(F.count_distinct("doc_id").alias("n_files"))
