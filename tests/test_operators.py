"""Small inline cases: fixed examples, nulls, empties, ties."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as fx
from textquarry.functions.profiles import HAN, LATIN, ZH
from textquarry.operators import blocks, corpus, graph, graph_edit, index, records
from textquarry.sources import files
from textquarry.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_text_zh(spark):
    raw = "正文\n--- 第2页 / 共139页 ---\nISBN: 978-7-1\n42\n结束"
    out = one(spark, fx.clean_text(F.lit(raw), ZH))
    assert "139" not in out and "978" not in out and "42" not in out and out.startswith("正文") and out.endswith("结束")


def test_clean_and_preprocess_zh_lines(spark):
    raw = "甲\n--- 3/12 ---\n7 / 9\nISBN-13：978-7\n版权信息 某社\n地址\n\n乙\n扫码关注\n（全书完）\n2024-01-31\n-5-\n[3] 注释\n[4]\n丙 • 丁\n完成。Y\n第3页/共9页"
    out = one(spark, fx.clean_text(F.lit(raw), ZH))
    assert not any(x in out for x in ("3/12", "7 / 9", "978", "某社", "地址", "扫码")) and "乙" in out and "2024-01-31" in out
    out = one(spark, fx.preprocess(F.lit(raw), ZH))
    assert not any(x in out for x in ("全书完", "2024", "-5-", "注释", "[4]", "978", "共9页", "。Y", "7 / 9")) and "丙\n- 丁\n完成。" in out


def test_name_candidates_han(spark):
    text = "叶文洁说道。汪淼问，叶文洁笑，骑着自行说。汪淼问道。汪淼说道！他们说道，平静地说道，平静地说道。红岸工程，红岸工程，"
    c = spark.createDataFrame([(1, 0, text), (2, 0, None)], "doc_id long, chunk_index int, chunk string")
    verbs = "说道|问道|笑道|答道|喊道|问|答|说|笑"
    got = {r["name"]: r["score"] for r in graph_edit.name_candidates(c, f"[{HAN}]{{2,4}}?", verbs, verbs, (), 30, ZH.not_first, ZH.not_last, fx.HAN_INSIDE).collect()}
    assert {"叶文洁", "汪淼"} <= set(got) and got["汪淼"] > 5
    assert not any(x.startswith(("他", "的")) or x.endswith("地") or "着" in x for x in got)


def test_valid_concept_han(spark):
    cases = {"球状闪电": True, "人际关系": True, "目的": False, "目的地": True, "和谐": True, "骑着自行": False, "的母亲": False, "母亲们": False, "意识到错误是事物的演变": False, "以及算法": False, "科": False, "科" * 17: False, "BERT": True, "": False}
    d = spark.createDataFrame([(k,) for k in cases] + [(None,)], "label string")
    got = {r["label"]: r["ok"] for r in d.select("label", fx.valid_concept("label", ("以及",)).alias("ok")).collect()}
    assert got == cases | {None: False}


def test_sentences_zh(spark):
    assert one(spark, fx.sentence_array(F.lit("你好。再见！\n完"), ZH)) == ["你好。", "再见！", "完"]


@pytest.mark.parametrize(("line", "level"), [("# A", 1), ("### A b", 3), ("第一章 开始", 1), ("第二部 起点", 0), ("1.2 Title", 2), ("3. Title", 2), ("body text here.", None), ("", None), (None, None)])
def test_heading_level(spark, line, level):
    assert one(spark, fx.heading_level(F.lit(line).cast("string"), ZH)) == level


def test_routes_zh(spark):
    df = spark.createDataFrame([("这本书多少字",), ("有哪些书",), ("你好",)], "text string")
    got = {r["text"]: (r["is_stats"], r["is_library"]) for r in fx.route_questions(df, profile=ZH).collect()}
    assert got == {"这本书多少字": (True, False), "有哪些书": (False, True), "你好": (False, False)}


def test_strip_bad_refs(spark):
    assert one(spark, fx.strip_bad_refs(F.lit("a[参考资料1]b[参考资料9]c[网页2]"), F.lit(3), F.lit(1))) == "a[参考资料1]bc"


def test_misc_columns(spark):
    assert one(spark, fx.slugify(F.lit("Hello World!"))) == "hello-world"
    assert one(spark, fx.slugify(F.lit("机器"))).startswith("concept-")
    assert one(spark, fx.parse_time(F.lit("nonsense"))) == 0.0
    assert one(spark, fx.parse_time(F.lit("1970-01-01T00:00:10Z"))) == 10.0
    assert one(spark, fx.score_to_weight(F.lit(None).cast("double"))) == 0.4
    assert one(spark, fx.collapse_cjk_spaces(F.lit("中 文 a b"))) == "中文 a b"
    assert one(spark, fx.interpret_rewrite(F.lit("better question\nmore words"), F.lit("q")))["rewrite"] == "better question"
    assert one(spark, fx.valid_volume_title(F.lit("A title"))) is True
    assert one(spark, fx.garbled_ratio(F.lit("ab�"))) == pytest.approx(1 / 3)


def test_windows_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "x" * 25), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    got = index.fixed_windows(docs, 10, 3).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], len(r["chunk"])) for r in got] == [(1, 10), (1, 10), (1, 10), (1, 4), (4, 3)]
    back = {r["doc_id"]: r["text"] for r in records.rebuild_text(index.fixed_windows(docs, 10, 3), 3, 3, "").collect()}
    assert back == {1: "x" * 25, 4: "abc"}


def test_bm25_prefers_the_match(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "green tree"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "whale"), (8, None)], "query_id long, text string")
    got = blocks.bm25_top(q, blocks.build(index.fixed_windows(docs)), 1).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(7, 2, 1)]


def test_vector_blocks_agree(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = lambda df: sorted((r["query_id"], r["vec_id"], r["score"]) for r in df.collect())
    assert rows(index.vector_search(q, v, 2)) == rows(index.vector_search(q, v, 2, max_queries=2))


def test_mmr_takes_both_clusters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 0.99])], "vec_id long, embedding array<float>")
    hits = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.89, 2), (0, 3, 0.8, 3), (0, 4, 0.79, 4)], "query_id long, vec_id long, score double, rank int")
    assert {r["vec_id"] for r in index.mmr(hits, v, 2).collect()} == {1, 3}


def test_components_and_chain(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.9), ("c", "a", 0.1), ("e", "d", 0.2), ("f", "f", 0.3)], "src string, dst string, weight double")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    chain = graph.concept_chains(edges, nodes.where("id = 'a'"), 4).orderBy("step").collect()
    assert [r["id"] for r in chain] == ["a", "b", "c"]
    assert {r["id"]: r["ring"] for r in graph.bfs_rings(nodes, edges, nodes.where("id = 'b'")).collect()}["a"] == 1


def test_components_of_a_long_path(spark):
    path = [f"n{i:04}" for i in [*range(2, 3001), 1]]
    nodes = spark.createDataFrame([(i,) for i in [*path, "lonely"]], "id string")
    edges = spark.createDataFrame(list(zip(path, path[1:])), "src string, dst string")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert len(got) == 3001 and got.pop("lonely") == "lonely" and set(got.values()) == {"n0001"}


def test_corpus_diff_by_tiers(spark):
    schema = "source_root string, rel_path string, name string, size long, mtime double, uploaded_at string"
    file = lambda path, mtime=10.0, root="/r": (root, path, path.rsplit("/", 1)[-1], 1, mtime, "2026")
    disk = spark.createDataFrame([file("a/x"), file("b/x"), file("a/y"), file("z"), file("a/x", root="/s"), file("n")], schema)
    indexed = spark.createDataFrame([file("a/x", 10.5), ("/r", "gone", "gone", 1, 1.0, "2027"), (None, "a/y", "y", 1, 110.0, None), (None, None, "z", 1, 10.0, None), (None, None, "lost", 1, 1.0, None)], schema)
    got = corpus.corpus_diff(disk, indexed)
    assert sorted((r["rel_path"] or "", r["name"], r["status"]) for r in got.collect()) == sorted(
        [("b/x", "x", "new"), ("a/x", "x", "new"), ("n", "n", "new"), ("a/y", "y", "modified"), ("gone", "gone", "deleted"), ("", "lost", "deleted")]
    )
    assert corpus.diff_counts(got, indexed).first().asDict() == {"new": 3, "modified": 1, "deleted": 2, "total_indexed": 5, "last_scan": "2027"}


def test_replace_and_delete(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "keep")], "doc_id long, chunk string")
    fresh = spark.createDataFrame([(1, "new")], "doc_id long, chunk string")
    assert {(r["doc_id"], r["chunk"]) for r in corpus.replace_documents(stored, fresh).collect()} == {(1, "new"), (2, "keep")}
    ids = spark.createDataFrame([("1",), (" ",), (None,), ("7",)], "id string")
    assert [r["doc_id"] for r in corpus.delete_documents(stored, ids).collect()] == [2]
    assert {r["id"]: r["removed"] for r in corpus.removed_counts(stored, ids).collect()} == {1: 1, 7: 0}
    assert corpus.delete_documents(stored, spark.createDataFrame([(None,)], "id string")).count() == 2


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(fx.canonical_label(F.lit("Ａｂ ｃ（x）"), {"abc": "letters"}, nfkc=True)) == "letters"
    assert one(fx.infer_category(F.lit("王小明"), ZH)) == "person" and one(fx.infer_category(F.lit("Dr. House"))) == "person"
    assert one(fx.narrative_expand(F.lit("桥水基金创建背景"), LATIN)) is None
    assert one(fx.narrative_expand(F.lit("history of Acme holdings"))) == "holdings " + " ".join(LATIN.history)


def test_map_rows_keeps_failures_apart(spark):
    from pyspark.sql.types import DoubleType

    got = {r["id"]: (r["result"], r["error"]) for r in records.map_rows(spark.range(3), lambda row: 1 / row["id"], DoubleType()).collect()}
    assert got[2] == (0.5, None) and got[0][0] is None and got[0][1].startswith("ZeroDivisionError")


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.PY").write_bytes(b"x = 1\xff")
    (tmp_path / "b.bin").write_bytes(b"no")
    rows = files.scan_corpus(spark, str(tmp_path)).select("*", files.path_identity(F.col("path"), str(tmp_path)).alias("i"), files.wrap_source_code(F.col("name"), F.col("text")).alias("code")).collect()
    assert [(r["name"], r["text"], r["i"]["rel_path"], r["i"]["rel_dir"]) for r in rows] == [("a.PY", "x = 1", "sub/a.PY", "sub")]
    assert rows[0]["code"] == "文件: a.PY\n```python\nx = 1\n```"
    files.export_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, "view" if i % 2 else "buy", i) for i in range(20)], "user_id long, document string, s long")
    events = events.select("user_id", "document", F.timestamp_seconds("s").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    jobs.reading_counter(stream, str(tmp_path / "reads"), str(tmp_path / "c1"), buckets=2).awaitTermination()
    whole = {tuple(r) for r in records.reading_records(events).collect()}
    same = lambda: {tuple(r) for r in jobs.read_store(spark, str(tmp_path / "reads")).select("user_id", "document", "first_read", "last_read", "read_count").collect()}
    assert same() == whole
    last = sorted(int(p.name[6:]) for p in (tmp_path / "reads").glob("bucket=*/batch=*"))[-1]
    assert all(len(list(p.glob("batch=*"))) <= 2 for p in (tmp_path / "reads").glob("bucket=*")) and last == 2

    docs = spark.createDataFrame([(1, "a" * 30), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    index_path = str(tmp_path / "index")
    chunks = lambda: {(r["doc_id"], r["chunk"]) for r in jobs.read_store(spark, index_path).collect()}
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    jobs.incremental_index(stream, index_path, str(tmp_path / "c2"), 10, 2, buckets=4).awaitTermination()
    more = spark.createDataFrame([(1, "new"), (2, "b"), (3, "")], "doc_id long, text string")
    more.write.mode("append").parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    jobs.incremental_index(stream, index_path, str(tmp_path / "c2"), 10, 2, buckets=4).awaitTermination()
    assert chunks() == {(1, "new"), (2, "b")}
    jobs.index_batch(more, 1, index_path, 10, 2, 4)  # a replayed batch changes nothing
    assert chunks() == {(1, "new"), (2, "b")}
    jobs.index_batch(spark.createDataFrame([(2, "")], docs.schema), 2, index_path, 10, 2, 4)
    assert chunks() == {(1, "new")}

    cache = str(tmp_path / "cache")
    batch = lambda *rows: spark.createDataFrame(list(rows), "key string, kind string, s long").select("key", "kind", F.timestamp_seconds("s").alias("ts"))
    live = lambda: sorted((r["key"], int(r["ts"].timestamp())) for r in jobs.read_store(spark, cache).collect())
    jobs.cache_batch(batch(("k", "normal", 0), ("d", "degraded", 0), ("k", "normal", 5)), 0, cache, {"normal": 600, "degraded": 60}, 3)
    assert live() == [("d", 0), ("k", 0)]
    jobs.cache_batch(batch(("k", "normal", 100), ("m", "normal", 100)), 1, cache, {"normal": 600, "degraded": 60}, 3)
    assert live() == [("k", 0), ("m", 100)]
    jobs.cache_batch(batch(("n", "normal", 101), ("o", "normal", 102)), 2, cache, {"normal": 600, "degraded": 60}, 3)
    assert live() == [("m", 100), ("n", 101), ("o", 102)]

    results = batch(("k", "normal", 100), ("k", "normal", 105), ("j", "normal", 101))
    results.coalesce(1).write.parquet(str(tmp_path / "results"))
    stream = spark.readStream.schema(results.schema).parquet(str(tmp_path / "results"))
    jobs.result_cache(stream, str(tmp_path / "cached"), str(tmp_path / "c3"), {"normal": 600}).awaitTermination()
    assert sorted((r["key"], int(r["ts"].timestamp())) for r in jobs.read_store(spark, str(tmp_path / "cached")).collect()) == [("j", 101), ("k", 100)]
