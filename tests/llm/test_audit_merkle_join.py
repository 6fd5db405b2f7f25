"""Filter audit, Merkle manifest and n-gram join against brute force and on edges."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("textquarry.llm")
from textquarry.llm import common, filter_audit, merkle, ngram_join  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos long, node string, id long, part string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def prose(r, n):
    return [r.choice(WORDS) + str(r.randrange(200)) for _ in range(n)]


def rows_of(texts, lang=lambda i: ("en", "fr", None)[i % 3]):
    return [(i, t, lang(i), f"s{i % 4}", len(t) if t else None, "h", 1, "n", 7, "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edge_rows():
    r = random.Random(5)
    long = " ".join(prose(r, 150))
    texts = [long, long, long, long.upper(), "", None, "", "a b c", "a  b c ", "\x0b\x0ca\tb\rc\n", "cash $5 " * 60, "x" * 200_000, " ".join(prose(r, 60_000)), "é　ü " * 120, "A" * 30 + " " + long]
    rows = rows_of(texts)
    return rows + [rows[0], rows[4], (None, long, "en", None, None, None, None, None, None, None), (None, long, "en", "s", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def audited(rows, labels):
    good, toxic = {d for d, q, t in labels if q == 1} - {None}, {d for d, q, t in labels if t == 1} - {None}
    fails = []
    for row in rows:
        d, text = row[0], row[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * any(o[0] is not None and d is not None and o[0] < d and (o[1] or "") == text for o in rows)
        fails.append((row[2] or "", set(f), d))
    out = {}
    for part in {p for p, _, _ in fails}:
        of, removed = [x for x in fails if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = of
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                removed[letter] += len(here)
                late = sum(letter in x[1] for x in of) - len(here)
                out[part, "".join(order), step] = [len(left), len(here), late, sum(x[1] == {letter} for x in of), sum(x[2] in good for x in here), sum(x[2] in toxic for x in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


@pytest.mark.parametrize("broadcast, deal", [(500_000, 1000), (0, 1)])
def test_filter_audit_equals_brute_force(spark, edge_rows, monkeypatch, broadcast, deal):
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", broadcast)
    monkeypatch.setattr(common, "DEAL_ROWS", deal)
    labels = [(0, 1, 0), (0, 0, None), (1, 1, 1), (4, 0, 1), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(edge_rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == audited(edge_rows, labels)
    assert len(got) == 3 * 600


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes):
    """Root and, for each leaf, the (left, right) flanks of its ancestors."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, x in zip(paths, at, strict=True):
            other = nodes[x ^ 1] if x ^ 1 < len(nodes) else ""
            path.append((other, "") if x % 2 else ("", other))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [x // 2 for x in at]
    return nodes[0], paths


def manifested(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for d, text, lang, source, n_chars, *_ in rows:
        groups.setdefault(lang, []).append((d, H(*map(told, (d, source, lang, n_chars, text)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree_of([x[1] for x in groups[g]])
    root, above = tree_of([trees[g][0] for g in names])
    return sorted((repr(d), g or "", leaf, trees[g][0], root, H(*(a + b for a, b in path + up))) for g, up in zip(names, above, strict=True) for (d, leaf), path in zip(groups[g], trees[g][1], strict=True))


def found(df):
    df = df.withColumn("proof", F.sha2(merkle.proof().cast("binary"), 256)).withColumn("folded", merkle.folded("leaf"))
    got = df.collect()
    assert all(r["folded"] == r["root"] for r in got)
    return sorted((repr(r["doc_id"]), r["lang"] or "", r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got)


def test_merkle_manifest_equals_brute_force_on_edges(spark, edge_rows):
    assert found(merkle.manifest(spark.createDataFrame(edge_rows, SCHEMA), FIELDS)) == manifested(edge_rows)


def test_merkle_manifest_over_several_tiers_and_groups(spark, monkeypatch):
    for name, value in (("DEPTH", 2), ("BLOCK", 4)):
        monkeypatch.setattr(merkle, name, value)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 16, "g": 17, "ü": 64, "A": 65, "z": 300, None: 70}
    rows = [(i * 7 % 613, f"t{i}", g, "s", i, "h", 1, "n", 7, "p") for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS)) == manifested(rows)


def test_merkle_manifest_of_many_equal_rows_and_of_one(spark):
    rows = rows_of(["same"], lambda i: "en") * 600
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(merkle.manifest(docs, FIELDS)) == manifested(rows)
    one = merkle.manifest(docs.limit(1), FIELDS).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    assert merkle.manifest(docs.limit(0), FIELDS).count() == 0


def test_merkle_proof_fails_for_a_changed_row(spark):
    docs = spark.createDataFrame(rows_of([f"t{i}" for i in range(300)]), SCHEMA)
    changed = merkle.leaf_digest("doc_id", "source", "lang", "n_chars", F.concat("text", F.lit("!")))
    got = merkle.manifest(docs, FIELDS, extra={"changed": changed}).withColumn("folded", merkle.folded("changed"))
    assert got.where("folded = root").count() == 0 and got.count() == 300


def grams(text, k=3):
    w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def joined(rows, percent=90):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = {row[0]: grams(row[1]) for row in rows if row[0] is not None}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(d for d, s in sets.items() if s), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sorted((repr(row[0]), len(grams(row[1])), repr(root(row[0]) if row[0] is not None else None)) for row in rows)


def told(df):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in df.collect())


def families(seed, n_families, size, steps):
    """Texts of families whose members differ from another member by 1 to ``steps`` words: similarities around the threshold."""
    r, out = random.Random(seed), []
    shared = prose(r, 40)
    for _ in range(n_families):
        members = [prose(r, r.choice((4, 30, 90, 240))) + shared * r.randint(0, 1)]
        for _ in range(size - 1):
            w = list(r.choice(members))
            for _ in range(r.randint(0, steps)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = prose(r, r.randint(0, 1))
                w = w or prose(r, 1)
            members.append(w)
        out += [" ".join(m) for m in members]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed, shard, rounds", [(1, 100_000, 3), (2, 9, 1), (3, 50, 0)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, seed, shard, rounds):
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
    rows = rows_of(families(seed, 30, 8, 4))
    assert told(ngram_join.join_documents(spark.createDataFrame(rows, SCHEMA))) == joined(rows)


def test_ngram_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "DEAL_ROWS", 20)
    r = random.Random(8)
    base = prose(r, 200)
    texts = [" ".join(base)] * 150
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = prose(r, 1)[0]
        texts.append(" ".join(w))
    rows = rows_of(texts)
    assert told(ngram_join.join_documents(spark.createDataFrame(rows, SCHEMA))) == joined(rows)


def test_ngram_join_at_a_lower_threshold(spark):
    rows = rows_of(families(4, 20, 8, 9))
    assert told(ngram_join.join_documents(spark.createDataFrame(rows, SCHEMA), percent=70)) == joined(rows, 70)


def test_ngram_join_edges(spark, edge_rows):
    assert told(ngram_join.join_documents(spark.createDataFrame(edge_rows, SCHEMA))) == joined(edge_rows)
    assert ngram_join.join_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_occurrences_counts_ids_of_enough_lists():
    r = random.Random(2)
    for _ in range(500):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(r.randint(1, 9))]
        least = r.randint(1, len(lists))
        times = Counter(x for own in lists for x in own)
        assert sorted(ngram_join.occurrences(lists, least)) == sorted((x, n) for x, n in times.items() if n >= least)


def test_word_hashes_tell_words_apart():
    for text in ("", "  ", "a", "A b  c\td\n", "x" * 40_000 + " Y" + "x" * 40_000 + " " + "x" * 39_999 + "y", "é ü \x0b a a", "ab " * 11_000 + "q" * 40_000 + " q"):
        raw = text.encode()
        w = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in raw).split()
        starts, h = ngram_join.word_hashes(raw)
        assert len(w) == len(h) and len({*zip(w, h, strict=True)}) == len({*w}) == len({*h})
        assert all(raw[a : a + len(x)].lower() == x for a, x in zip(starts, w, strict=True))
