import random
import re

import numpy as np
import pyarrow as pa
import pytest

from editlore.llm import chosen_path, decontamination, exact_topk
from editlore.llm.words import PLAIN, SPACED, Words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "text string, doc_id long, key string, label long, node long, items string"


def documents(spark, rows):
    return spark.createDataFrame([(t, i, "k", 1, 2, "x") for i, t in rows], DOCS)


def test_words_match_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é.9_\n-'ß日\0") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", "x" * 200_000]
    names = {}
    for table, find in ((PLAIN, lambda t: PLAIN_WORD.findall(t.translate(LOW))), (SPACED, lambda t: re.findall(r"[^\x00-\x20]+", t.translate(LOW)))):
        words = Words(texts, table)
        for k, text in enumerate(texts):
            want, got = find(text), words.hash[words.first[k]:words.first[k + 1]].tolist()
            assert len(want) == len(got)
            for word, h in zip(want, got):
                assert names.setdefault((id(table), h), word) == word


def brute_hits(docs, items, window=10):
    spans = {}
    for i, text in items:
        w = PLAIN_WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            spans.setdefault(tuple(w[k:k + window]), set()).add(str(i))
    out = []
    for i, text in docs:
        w = PLAIN_WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for span, ids in spans.items():
            for k in range(len(w) - len(span) + 1):
                if tuple(w[k:k + len(span)]) == span:
                    hit |= set(range(k, k + len(span)))
                    found |= ids
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_winnowing_equals_brute_force(spark, block_words):
    rng = random.Random(4)
    word = lambda: rng.choice("aa bb cc dd".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(30)] + [(77, None), (78, ""), (79, "..."), (80, "Zz"), (5, "same words here")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100 + k, " ".join(word() for _ in range(7)) + ", " + items[k][1].upper() + "! " + items[k + 1][1]) for k in range(20)]
    docs += [(200, None), (201, ""), (202, "zz"), (202, "zz"), (203, "Same; WORDS here " * 3000)]
    bench = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    found = decontamination.contamination(documents(spark, docs), bench, block_words=block_words)
    got = sorted(tuple(r) for r in found.selectExpr("doc_id", "n_words", "spans", "array_join(items, ',')").withColumn("spans", decontamination.n_hit()).collect())
    assert got == brute_hits(docs, items)


def test_winnowing_without_rows(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.contamination(documents(spark, [(1, "a b")]), bench).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in found] == [(2, [], [])]
    assert decontamination.contamination(documents(spark, []), bench).collect() == []


def test_decontamination_stage(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(12))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, [(1, f"before {text} after"), (2, "clean"), (3, None)])
    kept = decontamination.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}


def shingles(text):
    w = re.findall(r"[^\x00-\x20]+", (text or "").translate(LOW))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = group[a], group[b]
                group = [x if g == y else g for g in group]
    least = {g: min(docs[k][0] for k in range(len(docs)) if group[k] == g) for g in set(group)}
    return sorted((docs[k][0], least[group[k]], links[k]) for k in range(len(docs)))


@pytest.mark.parametrize("limit, depth", [(400, 8), (4, 3), (3, 0)])
def test_chosen_path_equals_brute_force(spark, limit, depth):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    common = text(40)  # a passage that unrelated texts share
    docs, number = [], 0
    for group in range(12):
        base = text(rng.randint(30, 80)) + (common if group % 2 else [])
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
            docs.append((number, " ".join(words)))
            number += 1
    docs += [(500, docs[0][1]), (501, docs[0][1].upper()), (502, None), (503, ""), (504, "three short words"), (505, "Three  short\nwords"), (506, "lone"), (507, "long text " * 9000)]
    got = chosen_path.similarity_classes(documents(spark, docs), limit=limit, depth=depth).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(docs)


def near_copies(n):
    """Texts of one group that differ in one or two of 60 words."""
    rng = random.Random(n)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(n):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        words[rng.randrange(60)] = f"y{k % 3}"
        docs.append((k, " ".join(words)))
    return docs


def test_near_copies_carry_their_buckets_and_meet_once_in_each(spark):
    limit, depth, runs = 4, 2, chosen_path.run_count()
    for n in (30, 120):
        rows = documents(spark, near_copies(n)).selectExpr("doc_id", "text", "true AS given", "0L AS mark")
        texts = chosen_path._sketched(rows, runs).select("key", "sketch", "roots")
        buckets = chosen_path._buckets(texts, limit, depth)
        leaves = chosen_path._leaves(buckets, texts, limit).collect()
        assert max(len(r.nodes) for r in leaves) <= runs * chosen_path.BRANCHES**depth  # whatever the size of the group
        met, sides = {}, {}
        for r in leaves:
            sides.setdefault((r.node, r.leaf), {}).setdefault(r.side, []).append(bytes(r.key))
        for (node, _), side in sides.items():
            whole = side.get(0, [])
            assert not whole or len(side) == 1
            pairs = [(a, b) for k, a in enumerate(whole) for b in whole[:k]] + [(a, b) for a in side.get(-1, []) for b in side.get(1, [])]
            met.setdefault(node, []).extend(tuple(sorted(p)) for p in pairs)
        of = {}
        for r in buckets.collect():
            of.setdefault(r.node, []).append(bytes(r.key))
        assert any(len(keys) > 4 * limit for keys in of.values())
        for node, keys in of.items():
            assert sorted(met.get(node, [])) == sorted(tuple(sorted((a, b))) for k, a in enumerate(keys) for b in keys[:k])


def test_a_large_group_of_near_copies_equals_brute_force(spark):
    docs = near_copies(200) + [(1000 + k, f"other text number {k} of no group at all") for k in range(5)]
    got = chosen_path.similarity_classes(documents(spark, docs), limit=6, depth=3).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(docs)


def test_owned_pairs_are_those_of_the_least_shared_bucket():
    rng = np.random.default_rng(9)
    lists = [sorted({7, *rng.integers(-20, 20, 5).tolist()}) for _ in range(30)]
    a, b = np.nonzero(np.triu(np.ones((30, 30)), 1))
    want = [min(set(lists[i]) & set(lists[j])) == 7 for i, j in zip(a, b)]
    nodes = pa.array([[0], *lists], pa.list_(pa.int64())).slice(1)
    assert any(want) and not all(want)
    assert chosen_path._owned(7, nodes, a, b).tolist() == want
    assert [chosen_path._owned(7, nodes, a[k:k + 1], b[k:k + 1])[0] for k in range(60)] == want[:60]


def test_chosen_path_repeated_rows_and_nothing(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert sorted(tuple(r) for r in chosen_path.similarity_classes(docs).collect()) == [(1, 1, 1, 3, 2), (1, 1, 1, 3, 2), (2, 1, 1, 3, 2)]
    assert chosen_path.similarity_classes(docs.limit(0)).collect() == []
    nameless = documents(spark, [(None, "a b c d e f"), (None, "g"), (None, None), (5, "a b c d e f")])
    assert sorted((r.doc_id or 0, r.n_copies, r.n_links) for r in chosen_path.similarity_classes(nameless).collect()) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (5, 2, 1)]
    assert sorted(r.text or "" for r in chosen_path.near_duplicates_stage(spark, nameless, "").collect()) == ["", "a b c d e f", "g"]
    kept = chosen_path.near_duplicates_stage(spark, docs, "")
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"\xf0", b"\xf1"), (b"\xf5", b"\xf5")], "key binary, root binary")
    labels = {bytes(r.key): bytes(r.label) for r in chosen_path.components(edges).collect()}
    assert {labels[bytes([k])] for k in range(41)} == {b"\0"} and labels[b"\xf1"] == b"\xf0" and b"\xf5" not in labels


def brute_top(rows, k=10):
    usable = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, dimension", [(4096, 64), (2, 64), (3, 5)])
def test_top_k_equals_brute_force(spark, block, dimension):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(900, dimension)).astype(np.float32)
    vectors[50:80] = vectors[50]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1100, [None] * dimension), (1200, [float("nan")] * dimension), (1201, [float("inf")] * dimension), (1300, []), (1400, [1.0, 2.0]), (1401, [3.0, 1.0])]
    frame = spark.createDataFrame([(v, i, 3, "x") for i, v in rows], "embedding array<float>, vec_id long, score int, rank string")
    got = sorted(tuple(r) for r in exact_topk.top_k(frame.repartition(5), block=block).collect())
    assert got == brute_top(rows)


def test_top_k_of_large_numbers_and_nothing(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e3, 1.0]), (2, [-1e12, 7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in exact_topk.top_k(frame).orderBy("rank").collect()] == [(1, 1024 * 10**9 * 1024 * 1000 + 3 * 1024 * 1024), (2, -2**63)]
    assert exact_topk.top_k(frame.limit(0)).collect() == []


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "a b c d e f g"), (1, "v w x y z aa bb"), (1, "v w x y z aa bb"), (2, "h i j k l m n"), (3, "h i j k l m n"), (1, "h i j k l m n o p q r s t u v w x y z"),
            (4, ""), (4, None), (4, "a b c d e f g"), (None, "null id text of seven words"), (None, "null id text of seven words")]
    docs = documents(spark, rows)
    kept = sorted((r.doc_id or 0, r.text or "") for r in chosen_path.near_duplicates_stage(spark, docs, "").collect())
    assert kept == sorted([(1, "a b c d e f g"), (1, "v w x y z aa bb"), (2, "h i j k l m n"), (1, "h i j k l m n o p q r s t u v w x y z"), (4, ""), (0, "null id text of seven words")])
    classes = {}
    for r in chosen_path.similarity_classes(docs).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(map(len, classes.values())) == [1, 2, 2, 2, 2, 2]
