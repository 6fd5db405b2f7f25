"""Small inline cases of outlines, evidence, graph changes and units: fixed examples, nulls, empties, ties."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions.profiles import ZH
from textquarry.operators import blocks, evidence, graph_edit, index, outline, ranks, records, units, vectors
from textquarry.sources import tables
from textquarry.streaming import jobs

DOCS = "doc_id long, text string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_inline_toc_block_goes(spark):
    at = [0, 3, 6, 9, 12, 200, 300, 400]
    h = spark.createDataFrame([(1, x, f"t{x}", 1) for x in at] + [(2, 0, "only", 1)], "doc_id long, line_no int, title string, level int")
    assert rows(outline.drop_inline_toc(h), "doc_id", "line_no") == [(1, 200), (1, 300), (1, 400), (2, 0)]


def test_contents_region_and_headings(spark):
    han = "前言\n目 录\n第 一 部 分 引子\n   1.1 细节\n        更深\n\n1 编号\n12\n书名：某书\n第 一 部 分 引子\n第一章 开始\n正文\n"
    long = "x" * 60
    three = "\n".join(["Contents", "One", "Two", "", long, "Three", long, "", long, "Four"])
    capped = "\n".join(["contents", *(f"entry {i}" for i in range(100))])
    d = spark.createDataFrame([(1, han), (2, None), (3, ""), (4, three), (5, capped), (6, "no such line"), (7, "Contents")], DOCS)
    got = rows(outline.toc_region(d), "doc_id", "line_no", "title", "level")
    assert got[:4] == [(1, 2, "第一部分引子", 0), (1, 3, "1.1 细节", 1), (1, 4, "更深", 2), (1, 6, "1 编号", 1)]
    # The line that ends it is the third in a row; the region ends three lines before that.
    assert [g for g in got if g[0] == 4] == [(4, 1, "One", 0), (4, 2, "Two", 0)]
    assert [g[1] for g in got if g[0] == 5] == list(range(1, 60)) and {g[0] for g in got} == {1, 4, 5}
    alone = outline.numbered_lines(spark.createDataFrame([(1, "x" * 30 + "\n\nShort one\n\n" + "y" * 30)], DOCS))
    assert rows(outline.inline_headings(alone), "line_no", "title", "level") == [(2, "Short one", 2)]
    marked = outline.numbered_lines(spark.createDataFrame([(1, "# 第一章 开始\ntext\n# 第二章 后来")], DOCS))
    assert rows(outline.inline_headings(marked, ZH), "line_no", "level") == [(0, 1), (2, 1)]


def test_markdown_outline_and_clean(spark):
    lines = outline.numbered_lines(spark.createDataFrame([(1, "# Chapter 1\n# Chapter 1 Dawn\n## Next\n## NEXT")], DOCS))
    got = outline.outline_from_markdown(lines)
    assert rows(got, "line_no", "title", "level") == [(1, "Chapter 1 Dawn", 0), (2, "NEXT", 1)]
    h = spark.createDataFrame([(1, 0, "ab", 1), (1, 1, "Real title", 1), (1, 2, "real title", 1), (1, 3, "1. you should do it", 1), (1, 4, None, 1)], "doc_id long, line_no int, title string, level int")
    assert rows(outline.outline_clean(h), "line_no") == [(1,)]


def test_parts_and_structure(spark):
    h = spark.createDataFrame([(1, 0, "lost", 1), (1, 1, "P", 0), (1, 2, "a", 1), (1, 3, "b", 1), (1, 4, "Q", 0)], "doc_id long, line_no int, title string, level int")
    assert rows(outline.chapters_to_parts(h), "part", "title") == [("P", "a"), ("P", "b")]
    assert rows(outline.structure_graph(h), "relation", "src", "dst") == [("contains", "P", "a"), ("contains", "P", "b"), ("next", "P", "Q"), ("next", "a", "b"), ("next", "lost", "a")]


def test_chapter_sample_bounds(spark):
    c = spark.createDataFrame([(1, i) for i in range(60)], "doc_id long, chunk_index int")
    got = outline.chapter_sample(c, c.where("chunk_index % 12 = 0"), 20)
    kept = [r[0] for r in rows(got, "chunk_index")]
    assert len(kept) == 20 and set(range(0, 60, 12)) <= set(kept)
    assert outline.chapter_sample(c, c.where("chunk_index < 0"), 5).count() == 5


def test_volumes_keep_their_distance(spark):
    text = "\n".join(["Early", "x" * 6000, "First", "x" * 100, "Close", "x" * 6000, "Second"])
    d = spark.createDataFrame([(1, text)], DOCS)
    h = outline.numbered_lines(d).where("length(line) < 10").selectExpr("doc_id", "line_no", "line AS title", "0 AS level")
    got = rows(outline.volumes(d, h), "volume_at", "volume", "rule", "chapter")
    assert got == [(6007, "First", "heading", "Close"), (12121, "Second", "heading", None)]


def test_volumes_of_a_collection(spark):
    """Volumes by headings and by lines, chapters with other white space, repeats in the front matter, stand-ins, and fragments that are none."""
    fill = "正文" * 3000
    parts = ["封面" * 1200, "球状闪电", "三体I", "超新星纪元", "尾卷", fill, "球状闪电", "第一章 死 星", fill, "三体I", "第一部 红岸", fill, "第二章 台球", "2024年12月", "要。"]
    parts += [fill, "超新星纪元", "第三章 一", "第四章 二", "第五章 三", fill, fill, fill, fill, "尾卷", "序 章", "中部 咒语", "序　章", "尾声", fill]
    text = "\n".join(parts)
    heads = [("球状闪电", 0), ("第一章 死星", 1), ("三体I", 0), ("第一部 红岸", 0), ("第二章 台球", 1), ("附录", 0), ("尾卷", 0), ("第三章 一", 1), ("第四章 二", 1), ("第五章 三", 1), ("一、列表", 2)]
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS)
    h = spark.createDataFrame([(1, i, t, level) for i, (t, level) in enumerate(heads)], "doc_id long, line_no int, title string, level int")
    got = outline.volumes(d, h).orderBy("volume_at", "chapter_at").collect()
    found = {}
    for r in got:
        assert text[r["volume_at"] :].startswith(r["volume"])
        found.setdefault((r["volume"], r["rule"]), []).append(r["chapter"])
    assert found == {
        ("球状闪电", "heading"): ["第一章 死星"],
        ("三体I", "heading"): ["第一部 红岸", "第二章 台球"],
        ("超新星纪元", "line"): ["第三章 一", "第四章 二", "第五章 三"],
        ("尾卷", "heading"): ["序 章", "中部 咒语", "尾声"],
    }


def test_outline_merging(spark):
    s = "doc_id long, line_no int, title string, level int"
    toc, inline = spark.createDataFrame([(1, 1, "One two", 0)], s), spark.createDataFrame([(1, 9, "onetwo", 1), (1, 10, "Three", 1)], s)
    assert rows(outline.merge_outlines(toc, inline), "origin", "title") == [(0, "One two"), (1, "Three")]
    p = spark.createDataFrame([(1, 1, 0, "A b!"), (1, 2, 0, "ab"), (1, 3, 0, None)], "doc_id long, chapter int, ord int, point string")
    assert [x[1] for x in rows(outline.outline_points_distinct(p, "-"), "chapter", "point")] == ["A b!", "-", "-"]


def test_tree_clean(spark):
    n = [("t", "r", None, 0, "root", None), ("t", "a", "r", 1, "x" * 50, " d "), ("t", "b", "a", 1, "deep", None), ("t", "c", "r", 2, None, None), ("u", "r", None, 0, "alone", None)]
    n += [("t", f"k{i}", "b", i, "k", None) for i in range(40)]
    got = outline.tree_clean(spark.createDataFrame(n, "tree string, node_id string, parent_id string, ord int, label string, description string"), 3)
    assert got.count() == 3 + 30 and rows(got.where("node_id = 'a'"), "label", "description", "depth") == [("x" * 20, "d", 1)]


def test_exact_sentences_and_windows(spark):
    d = spark.createDataFrame([(1, "Red fox runs. Blue whale sings. End."), (2, None), (3, "Blue whale sings. Red.")], DOCS)
    q = spark.createDataFrame([(1, 'who said "whale sings"'), (2, "red fox"), (3, None)], "query_id long, text string")
    got = evidence.exact_sentences(q, index.fixed_windows(d), 5)
    assert rows(got, "query_id", "place", "doc_id", "sentence")[:2] == [(1, 1, 1, "Blue whale sings."), (2, 1, 1, "Red fox runs.")]
    assert rows(got.where("query_id = 1"), "window_text") == [("Red fox runs.Blue whale sings.End.",)]
    spans = evidence.exact_sentences(spark.createDataFrame([(1, '"of the whale. It"')], "query_id long, text string"), index.fixed_windows(spark.createDataFrame([(7, "Sign of the whale. It ends.")], DOCS)), 5)
    assert rows(spans, "doc_id", "pos", "hit_count", "sentence") == [(7, 0, 1, "Sign of the whale. It ends.")]
    q = spark.createDataFrame([(1, "Ann met Bob")], "query_id long, text string")
    d = spark.createDataFrame([(1, "Ann left. He met Bob. They spoke."), (2, "Ann left. They spoke. Bob met.")], DOCS)
    assert rows(evidence.exact_sentences(q, index.fixed_windows(d), 9), "place", "doc_id", "pos", "hit_count") == [(1, 1, 1, 5), (2, 1, 0, 4), (3, 2, 2, 2)]


def test_exact_sentences_in_han_text(spark):
    d = spark.createDataFrame([(1, "红狐奔跑。蓝鲸在海里歌唱。完。"), (2, "无关。")], DOCS)
    q = spark.createDataFrame([(1, "蓝鲸"), (2, "“狐奔跑。蓝鲸”"), (3, "红狐 蓝鲸")], "query_id long, text string")
    got = rows(evidence.exact_sentences(q, index.fixed_windows(d), 5, ZH), "query_id", "place", "doc_id", "pos", "hit_count")
    assert got == [(1, 1, 1, 1, 1), (2, 1, 1, 0, 1), (3, 1, 1, 0, 4), (3, 2, 1, 1, 4)]


def test_entity_filter_falls_back(spark):
    e = spark.createDataFrame([(1, 1, "About Rome."), (1, 2, "nothing"), (2, 1, "plain")], "query_id long, doc_id long, sentence string")
    q = spark.createDataFrame([(1, "where is Rome"), (2, "no names")], "query_id long, text string")
    assert rows(evidence.evidence_entity_filter(e, q), "query_id", "sentence") == [(1, "About Rome."), (2, "plain")]


def test_pair_diff_and_location(spark):
    s = spark.createDataFrame([(1, "one two three four"), (1, "same"), (2, "one two three five"), (2, "same"), (2, "new")], "doc_id long, sentence string")
    r = evidence.document_pair_diff(s, spark.createDataFrame([(1, 2)], "a long, b long")).first()
    assert (r["n_added"], r["n_removed"], r["n_modified"], r["similarity"]) == (2, 1, 1, 0.25)
    d = spark.createDataFrame([(1, "a.b (c)\nd"), (2, None)], DOCS)
    ev = spark.createDataFrame([(1, "b (c) d"), (1, "zzz"), (2, "x"), (1, None)], "doc_id long, sentence string")
    assert rows(evidence.locate_evidence(ev, d), "start", "end") == [(-1, -1), (-1, -1), (-1, -1), (2, 9)]


def test_small_selections(spark):
    p = spark.createDataFrame([(1, "whale"), (1, "absent"), (9, "xy"), (9, "gone")], "segment_id long, point string")
    assert rows(evidence.reality_check(p, spark.createDataFrame([(1, "the wh ale")], "segment_id long, text string")), "point") == [("whale",), ("xy",)]
    q = spark.createDataFrame([(1, " a "), (2, None)], "query_id long, text string")
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "query_id long, ord int, text string")
    assert rows(evidence.query_variants(q, v), "query_id", "place", "text") == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_graph_changes(spark):
    nodes = spark.createDataFrame([(x, x.upper(), "concept") for x in "abc"], "id string, label string, category string")
    edges = spark.createDataFrame([("a", "b", "r", 1), ("b", "c", "r", 2), ("c", "c", "r", 3)], "src string, dst string, label string, edge_id int")
    left = graph_edit.remove_nodes(nodes, edges, nodes.where("id = 'b'"))
    assert [d.count() for d in left] == [2, 1, 1, 2]
    n, e = graph_edit.restore_nodes(*left, nodes.where("id = 'b'"))
    assert rows(n, "id") == rows(nodes, "id") and rows(e, "edge_id") == [(1,), (2,), (3,)]
    n, e = graph_edit.import_graph(nodes, edges, nodes.where("id != 'c'").withColumn("category", F.lit(None).cast("string")), edges, "x-")
    assert rows(n.where("id LIKE 'x-%'"), "id", "category") == [("x-a", "concept"), ("x-b", "concept")] and e.count() == 4
    marked = graph_edit.mark_source_removed(spark.range(3).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert rows(marked, "doc_id", "source_removed") == [(0, False), (1, True), (2, False)]


def test_categories_and_relations(spark):
    n = spark.createDataFrame([("Ada Lovelace", "people"), ("fairness", "person"), ("X", None), ("Acme", "org")], "label string, category string")
    assert rows(graph_edit.correct_category(n), "label", "category") == [("Acme", "organization"), ("Ada Lovelace", "person"), ("X", "concept"), ("fairness", "concept")]
    a = spark.createDataFrame([("has", "contains", 1), ("causes", "causes", 2)], "alias string, relation string, ord int")
    e = spark.createDataFrame([("causes",), ("it has causes",), ("?",), (None,)], "label string")
    assert {r["label"]: r["relation"] for r in graph_edit.normalize_relation(e, a).collect()} == {"causes": "causes", "it has causes": "contains", "?": None, None: None}


def test_graph_quality(spark):
    nodes = spark.createDataFrame([("a", "Aa", "p", 0.0, 0.0), ("b", "Bb", "q", 500.0, 0.0)], "id string, label string, category string, x double, y double")
    edges = spark.createDataFrame([("a", "b", "causes")], "src string, dst string, relation string")
    r = graph_edit.graph_quality(nodes, edges).first()
    assert r["score"] == pytest.approx(0.25 * 0.375 + 0.25 + 0.2 + 0.15 + 0.15 * 0.7, abs=1e-3) and r["passed"]
    empty = graph_edit.graph_quality(nodes.limit(0), edges.limit(0)).first()
    assert empty["score"] == 0.0 and not empty["passed"]


def test_web_results(spark):
    body = "a body that is long enough"
    r = [(1, 1, "T", "http://a.b/x", body), (1, 2, "T2", "http://a.b/x", body), (1, 3, "T", "http://e-ham.ru/", body), (1, 4, "casino", "http://c.d", body), (1, 5, "T", "http://e.f", "short"), (1, 6, None, "http://g.h", body)]
    q = spark.createDataFrame([(1, "q")], "query_id long, text string")
    got = graph_edit.filter_web_results(spark.createDataFrame(r, "query_id long, ord int, title string, url string, body string"), q, 5)
    assert rows(got, "place", "title", "url") == [(1, "T", "http://a.b/x")]


def test_page_chunks(spark):
    p = spark.createDataFrame([(1, 1, "a" * 150), (1, 2, "b" * 80), (2, 1, None)], "doc_id long, page int, text string")
    got = units.chunk_pages(p, 100, 20).orderBy("chunk_index").collect()
    assert [(r["doc_id"], r["page"], r["chunk"]) for r in got] == [(1, 1, "a" * 150), (1, 1, "a" * 20 + "\n" + "b" * 80), (1, 2, "b" * 20)]
    long = units.cut_pages([(1, "x" * 1000)], 100, 20)
    assert max(len(c) for _, c in long) < 400 and long[0] == (1, "x" * 100)


def test_paragraphs_and_units(spark):
    d = spark.createDataFrame([(1, "# Title\nfirst line\nsecond line.\n\nShort.\n\n" + "x" * 40), (2, None), (3, "")], DOCS)
    assert [r[1] for r in rows(units.merge_paragraphs(d), "pos", "paragraph")] == ["# Title", "first line second line. Short.", "x" * 40]
    d = spark.createDataFrame([(1, "aaa\n\nbbb\n\n```\ncode\n\nmore\n```\n\n" + "c" * 25), (2, "中文段落")], DOCS)
    got = rows(units.translation_units(d, 10), "doc_id", "pos", "unit", "skip")
    assert [g[2] for g in got] == ["aaa\n\nbbb", "```\ncode\n\nmore\n```", "c" * 10, "c" * 10, "c" * 5, "中文段落"] and [g[3] for g in got] == [False, True, False, False, False, True]


def test_generated_text(spark):
    p = spark.createDataFrame([("NASA and IBM met", "NASA and IBM"), ("NASA met", "FBI"), (None, None)], "source string, summary string")
    assert [(r["coverage"], r["n_invented"], r["passed"]) for r in units.summary_check(p).collect()] == [(1.0, 0, True), (0.0, 1, False), (1.0, 0, True)]
    raw = spark.createDataFrame([('[{"label":"a"}]',), ("x [{label: \"b\",},] y",), ('"label": "c"',), ("no",), (None,)], "raw string")
    assert [r["way"] for r in units.salvage_json(raw, "array<struct<label:string>>").collect()] == ["strict", "repaired", "labels", "none", "none"]


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.random((60, 30)) * (rng.random((60, 30)) < 0.3) * (0.7 ** np.arange(30))
    w = spark.createDataFrame([(int(d), 0, f"t{t:02d}", float(a[d, t])) for d, t in zip(*np.nonzero(a), strict=True)], "doc_id long, chunk_index int, term string, weight double")
    v, model = units.svd_embed(w.repartition(5), 6)
    ids, got = zip(*sorted((r["doc_id"], r["embedding"]) for r in v.collect()), strict=True)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(a[list(ids)] @ vt[:6].T), atol=1e-4) and np.allclose(np.linalg.norm(got, axis=0), s[:6], atol=1e-6)
    again = dict(rows(units.project(w, model), "doc_id", "embedding"))
    assert all(np.allclose(again[d], e) for d, e in zip(ids, got, strict=True))
    assert units.project(w.where("false"), model).count() == 0 and units.svd_embed(w.where("false"), 6)[0].count() == 0
    with pytest.raises(ValueError):
        units.project(w, model.unionByName(spark.createDataFrame([("x", [1.0])], model.schema)))


def test_results_expire_by_class(spark, tmp_path):
    schema, at = "key string, kind string, ts timestamp, value long", str(tmp_path / "in")

    def after(*rows_):
        """What has been passed on once these results have come, in a batch of their own."""
        d = spark.createDataFrame([(k, c, 1_000_000 + t, v) for k, c, t, v in rows_], "key string, kind string, s long, value long")
        d.select("key", "kind", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(at)
        stream = jobs.first_results(spark.readStream.schema(schema).parquet(at), {"normal": 600, "degraded": 60}, "0 seconds")
        jobs.run_to_end(stream, "", "append", str(tmp_path / "c"), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert after(("k", "normal", 5, 2), ("k", "normal", 0, 1), ("d", "degraded", 0, 3), ("x", "other", 0, 4), (None, "normal", 1, 5)) == [1, 3, 5]
    assert after(("k", "normal", 100, 6), ("d", "degraded", 100, 7), ("d", "degraded", 170, 8)) == [1, 3, 5, 7, 8]
    assert after(("k", "degraded", 601, 9), ("k", "degraded", 640, 10), ("d", "degraded", 200, 11)) == [1, 3, 5, 7, 8, 9]
    assert after(("k", "normal", 5000, 12), ("k", "normal", 300, 13)) == [1, 3, 5, 7, 8, 9, 12]  # value 13 comes too late


def test_gap_hints_and_stats_line(spark):
    chains = spark.createDataFrame([("b", 0, "b"), ("b", 1, "c")], "start string, step int, id string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("z", "b", 0.9), ("c", "b", 1.0)], "src string, dst string, weight double")
    assert rows(graph_edit.gap_hints(chains, edges), "side", "hint", "priority") == [("after", "(none)", "medium"), ("before", "z", "high")]
    stats = spark.createDataFrame([(1, 1234, 5, 1, 0)], "doc_id long, n_chars long, n_words long, n_sentences long, n_paragraphs long")
    assert stats.select(units.stats_text().alias("x")).first()["x"] == "Document 1: 1,234 characters, 5 words, 1 sentences, 0 paragraphs."


def test_running_sums_of_one_large_group(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("doc_id"), F.when(F.col("id") % 50 == 0, None).otherwise(F.lit("one")).alias("domain"), (F.col("id") % 11).alias("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = ranks.running(d, "domain", "doc_id", F.col("size"))
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 3000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for domain in ("one", None):
        part = sorted((r["doc_id"], r["number"], r["before"], r["size"]) for r in got.collect() if r["domain"] == domain)
        total = 0
        for i, (_, number, before, size) in enumerate(part, 1):
            assert (number, before) == (i, total)
            total += size


def test_evidence_of_a_long_document_is_found_in_linear_time(spark):
    import time

    r = np.random.default_rng(3)
    sentences = [" ".join(f"w{x}" for x in r.integers(0, 5000, 24)) + "." for _ in range(8000)]
    text = "\n ".join(sentences)
    assert len(text) > 1_000_000
    e = spark.createDataFrame([(1, i, x.replace(" ", "  ")) for i, x in enumerate(sentences)] + [(1, 8000, "not in it"), (1, 8001, " "), (1, 8002, None), (2, 8003, "lost")], "doc_id long, n int, sentence string")
    began = time.time()
    got = {x["n"]: (x["start"], x["end"]) for x in evidence.locate_evidence(e, spark.createDataFrame([(1, text), (2, None)], DOCS)).collect()}
    assert time.time() - began < 30
    at = 0
    for i, x in enumerate(sentences):
        assert got[i] == (at, at + len(x))
        at += len(x) + 2
    assert [got[i] for i in range(8000, 8004)] == [(-1, -1)] * 4


def test_modified_sentences_equal_brute_force(spark):
    r = np.random.default_rng(1)
    pool = [f"w{i}" for i in range(30)]
    docs = {d: {" ".join(r.choice(pool, r.integers(1, 9))) for _ in range(25)} for d in range(4)}
    s = spark.createDataFrame([(d, x) for d, xs in docs.items() for x in xs], "doc_id long, sentence string")
    got = {(x["a"], x["b"]): x["n_modified"] for x in evidence.document_pair_diff(s, spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")).collect()}
    for a, b in got:
        gone, new = docs[a] - docs[b], docs[b] - docs[a]
        like = lambda x, y: 2 * len({*x.split()} & {*y.split()}) >= len({*x.split()} | {*y.split()})
        assert got[a, b] == sum(any(like(x, y) for y in new) for x in gone) > 0


def test_the_last_question_is_whole(spark):
    m = spark.createDataFrame([(1, 1, "user", "q" * 1_200_000)], "conv_id long, turn long, role string, text string")
    got = {x["part"]: len(x["text"]) for x in records.conversation_window(m).collect()}
    assert got == {"question": 1_200_000, "recent": 200}


def test_bm25_blocks_equal_brute_force(spark, monkeypatch):
    """Small blocks, groups of queries, ties, and early stops give the rows of a plain sum."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    r = np.random.default_rng(5)
    words = [f"t{int(x)}" for x in r.zipf(1.4, 3000) % 60]
    docs = [(i, " ".join(words[i * 20 : i * 20 + r.integers(0, 20)])) for i in range(150)]
    docs[3], docs[7] = (3, "t1 t2 t9"), (7, "t1 t2 t9")
    queries = [(i, " ".join(r.choice(words, 4))) for i in range(30)] + [(30, None), (31, "none such"), (32, "t1 t1 t2")]
    index_ = blocks.build(index.fixed_windows(spark.createDataFrame(docs, DOCS)))
    q = spark.createDataFrame(queries, "query_id long, text string")
    toks = {d: t.split() for d, t in docs if t}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * np.mean(list(raw.values()))
    want = []
    for i, text in queries:
        scores = []
        for d, t in toks.items():
            s = sum((raw[w] if raw[w] >= 0 else floor) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in (text or "").split() if w in df)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        want += [(i, d, place) for place, (_, d) in enumerate(sorted(scores)[:5], 1)]
    for most in (500_000, 20):
        assert rows(blocks.bm25_top(q, index_, 5, most_terms=most), "query_id", "doc_id", "rank") == sorted(want)


def test_vector_lists_find_what_a_scan_finds(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    m = centres[r.integers(0, 12, 1500)] + 0.3 * r.normal(size=(1500, 16))
    v = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(m)] + [(9999, 0, None)], "doc_id long, chunk_index int, embedding array<double>")
    q = spark.createDataFrame([(i, m[i * 10].tolist()) for i in range(100)] + [(100, None)], "query_id long, embedding array<double>")
    ivf = vectors.build(v)
    want = set()
    for i in range(100):
        s = np.round(m @ m[i * 10], 6)
        want |= {(i, int(d)) for d in sorted(range(1500), key=lambda d: (-s[d], d))[:10] if s[d] > 0.01}
    pairs = lambda df: {(x["query_id"], x["doc_id"]) for x in df.collect()}
    assert pairs(vectors.search(q, ivf, 10, probes=None)) == want
    assert len(pairs(vectors.search(q, ivf, 10)) & want) >= 0.9 * len(want)
    assert vectors.search(q, vectors.build(v.where("doc_id < 0")), 10).count() == 0


def test_rows_of_megabytes_lie_in_small_row_groups(spark):
    """A task that reads the index or the lists holds a row group at once: some blocks, not all that its file has."""
    import pyarrow.parquet as pq
    from textquarry.operators import blocks as bl
    from textquarry.operators.index import fixed_windows

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    index = bl.build(fixed_windows(docs), bigrams=True)
    assert index.count() >= 4
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) <= 16 << 20


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_pair_diff_shuffles_documents_only(spark):
    """No row for a word or a pair of sentences: the pair's two documents meet in one row, copies of a pair count once, absent sides are empty."""
    s = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "only here"), (2, 0, "a b c x"), (2, 1, "new one"), (2, 2, "!")], "doc_id long, pos int, sentence string")
    got = evidence.document_pair_diff(s, spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4)], "a long, b long"))
    assert "Generate" not in _plan(got)
    assert rows(got, "a", "b", "n_added", "n_removed", "n_modified", "similarity") == [(1, 2, 2, 2, 1, 0.0), (2, 3, 0, 2, 0, 0.0)]


def test_pages_are_cut_without_a_python_call_a_document(spark):
    p = spark.createDataFrame([(1, 2, "b" * 80), (1, 1, "a" * 150), (2, 1, None)], "doc_id long, page int, text string")
    got = units.chunk_pages(p, 100, 20)
    assert "FlatMapGroups" not in _plan(got)
    assert {(r["doc_id"], r["page"]) for r in got.collect()} >= {(1, 1)}


def test_joints_are_compared_by_their_ends(spark):
    from textquarry.operators import records

    c = spark.createDataFrame([(1, 0, "x" * 500 + "0123456789"), (1, 1, "0123456789" + "y" * 500), (1, 2, None)], "doc_id long, chunk_index int, chunk string")
    got = records.rebuild_text(c)
    assert "lag(tail" in _plan(got)
    assert got.first()["text"] == "x" * 500 + "0123456789\n" + "y" * 500


def test_texts_are_cut_some_at_a_time(spark):
    """A task holds SLICE texts, not a batch of ten thousand, and none is lost at a slice's end."""
    n = 2 * units.SLICE + 3
    got = units._per_text(spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text").coalesce(1), lambda t: [t, "+"], "piece")
    assert "MapInArrow" in _plan(got) and "MapInPandas" not in _plan(got)
    assert rows(got, "doc_id", "pos", "piece") == sorted((i, j, x) for i in range(n) for j, x in enumerate((f"t{i}", "+")))


def test_sentences_are_located_some_documents_at_a_time(spark):
    n = 2 * evidence.SLICE + 3
    d = spark.range(n).selectExpr("id AS doc_id", "concat('ab ', id, '. cd') AS text").coalesce(1)
    e = d.selectExpr("doc_id", "'. cd' AS sentence")
    assert rows(evidence.locate_evidence(e, d), "doc_id", "start", "end") == [(i, 3 + len(str(i)), 7 + len(str(i))) for i in range(n)]


def test_vectors_are_scored_in_blocks_with_ties(spark):
    import numpy as np

    from textquarry.operators import index as ix

    n = 2 * ix.VECTOR_BLOCK + 5
    m = np.random.default_rng(1).integers(-2, 3, (n, 4)).astype(float)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>").coalesce(1)
    got = ix.vector_search(v.where("vec_id % 500 = 0").selectExpr("vec_id AS query_id", "embedding AS query"), v, 10)
    want = [(q, i, m[q] @ m[i], r + 1) for q in range(0, n, 500) for r, i in enumerate([i for i in np.lexsort((np.arange(n), -(m @ m[q]))) if m[q] @ m[i] > 0.01][:40])]
    assert rows(got, "query_id", "vec_id", "score", "rank") == sorted(want)


def _exact_by_hand(q, chunks, k):
    """C7 for term queries {id: words} over {(doc_id, chunk_index): sentences}: (query_id, place, doc_id, chunk_index, pos, hit_count)."""
    out = []
    for i, terms in q.items():
        first = {}
        for at in sorted((d, c, p) for (d, c), ss in chunks.items() for p in range(len(ss))):
            n = len(terms & set(chunks[at[:2]][at[2]].rstrip(".").split(" ")))
            if n:
                first.setdefault(chunks[at[:2]][at[2]][:80], (-n, *at))
        seen, chosen = {}, []
        for x in sorted(first.values()):
            seen[x[1:3]] = seen.get(x[1:3], 0) + 1
            chosen += [x] if seen[x[1:3]] <= 2 else []
        out += [(i, r + 1, *x[1:], -x[0]) for r, x in enumerate(chosen[:k])]
    return sorted(out)


def test_exact_scan_counts_pairs_inside_tasks(spark):
    """No pair of a query and a sentence is shuffled; late copies with more hits than their first sentence make the two passes run again."""
    import random

    rnd = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(12)]
    long = ["x" * 82 + str(i) for i in range(3)]
    chunks = {(d, c): [" ".join([*([x[:82]] if (x := rnd.choice(long + [""])) else []), *rnd.choices(words, k=rnd.randint(1, 6))]) + "." for _ in range(5)] for d in range(40) for c in range(2)}
    # The first document has every prefix with one hit; later ones repeat it with more.
    head = [f"{i:02d}" + "y" * 78 for i in range(60)]
    chunks[(0, 0)] = [f"{h} waa." for h in head]
    for d in range(50, 90):
        chunks[(d, 0)] = [f"{h} waa wbb wcc wdd." for h in rnd.sample(head, 9)]
    q = {1: {"waa", "wbb", "wcc", "wdd"}, 2: {"wee", "wff"}, 3: {"nowhere"}}
    queries = spark.createDataFrame([(i, " ".join(sorted(t))) for i, t in q.items()], "query_id long, text string")
    c = spark.createDataFrame([(*at, " ".join(ss)) for at, ss in chunks.items()], "doc_id long, chunk_index int, chunk string").repartition(5)
    got = evidence.exact_sentences(queries, c, 3)
    assert "Generate" not in _plan(got)
    assert rows(got, "query_id", "place", "doc_id", "chunk_index", "pos", "hit_count") == _exact_by_hand(q, chunks, 3)


def test_components_read_the_edges_once(spark):
    """Rounds work on what they left of the edges, not on the edges' own plan; the smallest id names a component, ends that are no nodes link nothing."""
    import random

    from textquarry.operators import graph

    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (8, 999), (999, 9)]
    up = {i: i for i in range(500)}
    root = lambda i: i if up[i] == i else root(up[i])
    for a, b in pairs:
        if a in up and b in up:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    read = spark.sparkContext.accumulator(0)
    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 3).map(lambda p: (read.add(1), p)[1]), "src long, dst long")
    got = rows(graph.components(spark.range(500), edges), "id", "component")
    assert got == [(i, root(i)) for i in range(500)]
    assert read.value == len(pairs)


def test_graph_queries_read_the_texts_once(spark):
    from textquarry.plans import graphs

    for df in graphs._graph(spark, "/root/testdata/sf0.001"):
        assert "documents.parquet" not in " ".join(df.inputFiles())


def test_overlaps_by_half_of_the_neighbours(spark):
    import random

    from textquarry.operators import graph

    rnd = random.Random(6)
    at = [(f"n{i}", rnd.uniform(-120, 120), rnd.uniform(-120, 120)) for i in range(90)]
    got = graph.layout_overlap(spark.createDataFrame(at, "id string, x double, y double"))
    want = sorted((a, b) for a, ax, ay in at for b, bx, by in at if a < b and (ax - bx) ** 2 + (ay - by) ** 2 < 2500)
    assert rows(got, "a", "b") == want


def _toc_by_hand(text):
    """E12 line by line: (line_no, title) of documents without Han spaces."""
    import re

    ls = text.split("\n")
    at = next((i for i, x in enumerate(ls) if re.search(outline.TOC_TITLE, x.strip(" \t　"))), None)
    if at is None:
        return []
    bad, end = 0, None
    for i, x in enumerate(ls[at + 1 : at + 1 + outline.TOC_SCAN]):
        own = x.strip(" \t　")
        entry = own != "" and len(own) < 50
        bad = 0 if entry else bad + 1
        if own and not entry and bad >= 3:
            end = max(i - 3, 0)
        elif re.search(outline.TOC_CHAPTER, own):
            end = i
        if end is not None:
            break
    out, seen = [], set()
    for i, x in enumerate(ls[at + 1 :][: outline.TOC_TAKEN if end is None else end]):
        own = x.strip(" \t　")
        if len(own) > 1 and own.lower() not in seen and own.lower() != "contents" and not re.search("^[iIvVxX0-9]+$", own):
            seen.add(own.lower())
            out.append((at + 1 + i, own))
    return out


def test_contents_regions_stay_in_their_row(spark):
    """No shuffle, and the contents line is looked for once; ends as by the rule line by line."""
    import random

    rnd = random.Random(8)
    long = "word " * 12
    line = lambda: rnd.choice(["", "  ", long, long, f"entry {rnd.randrange(30)}", f"  Entry {rnd.randrange(30)}", f"　part {rnd.randrange(9)} ", "x", "第3章 end" if rnd.random() < 0.2 else "more"])
    docs = [(i, "\n".join([*(line() for _ in range(rnd.randrange(4))), *(["Contents"] if i % 9 else []), *(line() for _ in range(rnd.choice([3, 12, 90])))])) for i in range(150)]
    docs += [(900 + i, "\n".join(["contents", *(rnd.choice(["", f"entry {j}"]) for j in range(100))])) for i in range(5)]
    got = outline.toc_region(spark.createDataFrame(docs, DOCS))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and _plan(got).split("Optimized")[1].split("Physical")[0].count("split(") == 1
    assert rows(got, "doc_id", "line_no", "title") == sorted((d, *x) for d, t in docs for x in _toc_by_hand(t))


def test_volumes_read_texts_and_headings_once(spark):
    """Lines, titles and places are stored; a title of 80 characters has a place, though it lies between spaces, and one of 81 has none."""
    names = ["Volume One", "Part of " + "x" * 12, "y" * 80, "z" * 81]
    text = "\n".join(["w " * 2600, " Volume  One\t", "　" + names[1], "w" * 100, "\t" + names[2] + "　", names[3]])
    heads = [(i, n, names[n], 1 if n else 0) for i in range(6) for n in range(4)]
    read = {c: spark.sparkContext.accumulator(0) for c in "dh"}
    make = lambda c, data, schema: spark.createDataFrame(spark.sparkContext.parallelize(data, 2).map(lambda x: (read[c].add(1), x)[1]), schema)
    d = make("d", [(i, text) for i in range(6)] + [(9, None)], DOCS)
    h = make("h", heads + [(i, 10 + n, t, 2) for i, n, t, _ in heads], "doc_id long, line_no int, title string, level int")
    got = rows(outline.volumes(d, h), "doc_id", "volume_at", "volume", "rule", "chapter_at", "chapter")
    at = [len("\n".join(text.split("\n")[:n])) + 1 for n in (1, 2, 4)]
    assert got == [(i, at[0], names[0], "heading", p, c) for i in range(6) for p, c in ((at[1], names[1]), (at[2], names[2]))]
    assert read["d"].value == 7 and read["h"].value == 2 * len(heads)


def _shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    import time

    sc = spark.sparkContext._jsc.sc()
    time.sleep(0.5)  # figures of tasks are taken over every 100 ms
    spark.range(1).count()
    sc.listenerBus().waitUntilEmpty(10_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def _bytes(df):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())


def test_gram_matrix_is_summed_once_by_few_tasks(spark, monkeypatch):
    """Sums that are shuffled do not grow with the pieces of the matrix, and all three ways of adding give the same vectors."""
    r = np.random.default_rng(4)
    a = r.random((400, 200)) * (r.random((400, 200)) < 0.2) * (0.98 ** np.arange(200))
    held = [(d, 0, np.flatnonzero(x).tolist(), x[x > 0].tolist()) for d, x in enumerate(a)]
    matrix = tables.stored(spark.createDataFrame(held, "doc_id long, chunk_index int, i array<int>, x array<double>").repartition(40), "matrix")
    terms, was = [f"t{i:03d}" for i in range(200)], _shuffled(spark)
    small = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        got = dict(rows(units.svd_of(matrix, terms, 100)[0], "doc_id", "embedding"))
    finally:
        for key in small:
            spark.conf.unset(key)
    assert _shuffled(spark) - was < 1e6
    assert np.allclose(np.linalg.norm(list(got.values()), axis=0), np.linalg.svd(a, compute_uv=False)[:100], atol=1e-2)
    for name, value in (("PAIRED", 5), ("GRAM_TERMS", 0)):
        monkeypatch.setattr(units, name, value)
        again = dict(rows(units.svd_of(matrix, terms, 100)[0], "doc_id", "embedding"))
        assert all(np.allclose(again[d], got[d], atol=1e-6) for d in got)


def test_vocabulary_of_terms_that_no_block_has_often(spark, monkeypatch):
    """Exact counts, ties by term, whatever the blocks give at first."""
    from collections import Counter

    docs = [(i, " ".join([*[f"d{i}a d{i}b d{i}c"] * 9, "thin", *["even"] * (i % 4 == 0)])) for i in range(40)]
    docs += [(99, ""), (98, None)]
    freq, df = Counter(), Counter()
    for _, text in docs:
        words = (text or "").split()
        grams = [*words, *map(" ".join, zip(words, words[1:]))]
        freq.update(grams)
        df.update(set(grams))
    monkeypatch.setattr(blocks, "BLOCK", 4)
    built = blocks.build(index.fixed_windows(spark.createDataFrame(docs, DOCS)).coalesce(1), bigrams=True)
    assert built.count() == 10 and not any(" " in t for r in built.collect() for t in r["term"])
    for most, able in ((4, 8), (1, 8), (1, 1)):
        monkeypatch.setattr(blocks, "GIVEN", most)
        monkeypatch.setattr(blocks, "ABLE", able)
        for n in (1, 7, 200, 10_000):
            want = sorted(freq, key=lambda t: (-freq[t], t))[:n]
            got = blocks.vocabulary(built, n).collect()
            assert {(r["term"], r["df"]) for r in got} == {(t, df[t]) for t in want} and len(got) == len(want)
            assert all(abs(r["idf"] - np.log(41 / (1 + r["df"])) - 1) < 1e-12 for r in got)
    assert blocks.vocabulary(built.where("false"), 5).count() == 0


def test_vocabulary_shuffles_a_few_terms_of_a_block(spark):
    docs = tables.table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 4 = 0")
    built = blocks.build(index.fixed_windows(docs).coalesce(2), bigrams=True)
    terms, was = sum(r["n"] for r in built.select((F.size("df")).alias("n")).collect()), _shuffled(spark)
    assert blocks.vocabulary(built, 200).count() == 200
    assert _shuffled(spark) - was < 4 * terms


def test_lists_of_svd_vectors_hold_counts(spark):
    """Rows that lists, samples and shuffles hold are counts of terms; hits are those of the vectors themselves."""
    docs = tables.table(spark, "/root/testdata/sf0.01", "documents")
    built = blocks.build(index.fixed_windows(docs), bigrams=True)
    counts, names, idf = blocks.term_counts(built, blocks.vocabulary(built, 1000))
    dense = tables.stored(units.svd_of(blocks.weighed(counts, idf), names, 384)[0], "vectors")
    embed, was = units.embedder(spark, units.components(blocks.weighed(counts, idf), len(names), 384), idf), _shuffled(spark)
    lists = vectors.build(counts, embed=embed)
    assert _shuffled(spark) - was < _bytes(dense) / 2 and _bytes(lists.packs) < _bytes(dense) / 6
    q = dense.where("doc_id % 50 = 0 AND chunk_index = 0").selectExpr("doc_id AS query_id", "embedding")
    hits = lambda ivf, **k: sorted((r["query_id"], r["doc_id"], r["chunk_index"], r["score"], r["rank"]) for r in vectors.search(q, ivf, 10, **k).collect())
    whole = vectors.build(dense)
    assert np.allclose(whole.centroids, lists.centroids)
    assert len(hits(lists)) > 100 and hits(lists) == hits(whole) and hits(lists, probes=None) == hits(whole, probes=None)
    assert sum(len(r["doc_id"]) for r in lists.packs.collect()) == counts.count()
