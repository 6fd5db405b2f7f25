"""Operators that SQL cannot say, against plain brute force over whole small tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import blocks, index, units
from textquarry.plans import retrieval, unit_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def last_break(text, lo, hi):
    """(place, width) of the last blank line, else line end, that lies wholly in text[lo:hi]."""
    for mark in ("\n\n", "\n"):
        found = [m.start() for m in re.finditer(f"(?={mark})", text) if lo <= m.start() and m.start() + len(mark) <= hi]
        if found:
            return found[-1], len(mark)
    return None


def test_pages_are_cut_as_by_hand(spark, texts):
    want = []
    for doc, text in texts.items():
        pages = [text[i : i + 1000] for i in range(0, max(1, len(text)), 1000)] if text else []
        held, label, n = "", 1, 0
        for number, page in enumerate(pages):
            held += page + "\n"
            todo = 1 if len(held) < 2048 else None  # one cut, or as many as it takes
            while len(held) >= 512 and todo != 0:
                if todo:
                    found = last_break(held, 204, len(held))
                    at, todo = (found[0] if found else len(held)), 0
                elif len(held) >= 2048:
                    found = last_break(held, 204, 562)
                    at = sum(found) if found else 512
                else:
                    break
                want.append((doc, n, label, md5(held[:at].strip())))
                held, n = held[max(at - 50, 0) :], n + 1
            label = number
        if held.strip():
            want.append((doc, n, label, md5(held.strip())))
    got = [(r["doc_id"], r["chunk_index"], r["page"], r["chunk_md5"]) for r in unit_queries.chunk_pages(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 500


def test_paragraphs_keep_all_text_and_their_rules(spark, texts):
    flat = lambda t: re.sub(r"\s", "", t)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {}
    for r in units.merge_paragraphs(docs).orderBy("doc_id", "pos").collect():
        parts.setdefault(r["doc_id"], []).append((r["paragraph"], r["level"]))
    for doc, text in texts.items():
        own = [p for p, _ in parts.get(doc, [])]
        assert flat("".join(own)) == flat(text) and [r for r in own if not r.strip()] == []
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        assert len(own) <= len(lines)
        # Short ones have joined the one before; only a first one or one at a heading may be short.
        head = re.compile(r"#|第[一二三四五六七八九十百0-9]+[章节部篇卷]|(?i:(?:chapter|part) +[0-9])")
        assert all(len(b) >= 15 or head.match(b) or head.match(a) for a, b in zip(own, own[1:]))
        # A paragraph never begins inside a line.
        starts = {flat(x)[:20] for x in lines}
        assert all(flat(p)[:20] in starts or any(flat(p).startswith(s) for s in starts) for p in own)


def test_units_are_greedy_and_whole(spark, texts):
    flat = lambda t: re.sub(r"\s", "", t)
    docs, most = spark.read.parquet(f"{SF}/documents.parquet"), 3500
    parts = {}
    for r in units.translation_units(docs, most).orderBy("doc_id", "pos").collect():
        parts.setdefault(r["doc_id"], []).append(r["unit"])
    for doc, text in texts.items():
        own = parts.get(doc, [])
        assert flat("".join(own)) == flat(text)
        assert all(len(u) <= most for u in own if "```" not in u)
        paragraphs = [p.strip("\n") for p in re.split(r"\n\s*\n", text) if p.strip()]
        if paragraphs and "```" not in text and all(len(p) <= most for p in paragraphs):
            want = [paragraphs[0]]
            for p in paragraphs[1:]:
                if len(want[-1]) + 2 + len(p) <= most:
                    want[-1] += "\n\n" + p
                else:
                    want.append(p)
            assert own == want


def test_reranking_picks_as_by_hand(spark):
    hits, pool = {}, {}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    for r in retrieval.vector_search(spark, SF).collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = set()
    for q, rows in hits.items():
        pool = [(v, s) for rank, v, s in sorted(rows) if rank <= 20]
        chosen = []
        if len(pool) <= 5:
            chosen = [v for v, _ in pool]
        while len(chosen) < min(5, len(pool)):
            cos = lambda a, b: float(vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]))
            value = [(0.7 * s - 0.3 * max((cos(v, c) for c in chosen), default=0.0), -i) for i, (v, s) in enumerate(pool) if v not in chosen]
            best = max(value)
            if best[0] <= -1:
                break
            chosen.append(pool[-best[1]][0])
        want |= {(q, v, i) for i, v in enumerate(chosen, 1)}
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in retrieval.mmr_rerank(spark, SF).collect()} == want and want


def test_svd_of_all_chunks_is_as_good_as_numpys(spark):
    c = index.fixed_windows(spark.read.parquet(f"{SF}/documents.parquet"))
    built = blocks.build(c, bigrams=True)
    matrix, terms = blocks.sparse_rows(built, blocks.vocabulary(built, 1500))
    rows = matrix.collect()
    a = np.zeros((len(rows), len(terms)))
    for n, r in enumerate(rows):
        a[n, r["i"]] = r["x"]
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    vectors, model = units.svd_of(matrix, terms, 32)
    v = np.array([r["component"] for r in model.orderBy("term").collect()])
    s = np.linalg.svd(a, compute_uv=False)
    best = np.sqrt((s[32:] ** 2).sum())
    assert np.linalg.norm(a - a @ v @ v.T) <= 1.01 * best
    got = {(r["doc_id"], r["chunk_index"]): r["embedding"] for r in vectors.collect()}
    assert len(got) == len(rows)
    assert np.allclose([got[r["doc_id"], r["chunk_index"]] for r in rows], a @ v)
    assert vectors.where(F.size("embedding") != 32).count() == 0
