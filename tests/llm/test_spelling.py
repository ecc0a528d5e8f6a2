import random
import re
import zlib
from collections import Counter

import pytest

from editlore.llm import spelling
from editlore.llm.spelling import near_words, op11_spelling_variants, variants, word_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "text string, word string, doc_id long, n long, most int, key string"


def documents(spark, rows):
    return spark.createDataFrame([(t, "w", i, 1, 2, "k") for i, t in rows], DOCS)


def brute_words(rows, min_points=6, least=5):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_points and n >= least}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, o) for o, m in words.items() if one_edit(w, o))
        form = near[0] if near and -near[0][0] >= 5 * n else None
        out[w] = [form and form[1], w, n, len(near), form and -form[0]]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def shown(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("tile, cells", [(512, 4_000_000), (3, 200)])
def test_variants_equal_brute_force(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(spelling, "CELLS", cells)
    rng = random.Random(tile)
    words = {}
    for _ in range(700):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 5, 6, 6, 7, 8, 9])))
        words[w] = rng.choice([5, 6, 25, 30, 150, 800, 5_000])
    for k in range(200):  # a tile that holds a third of all words
        words["prefixe" + "".join(rng.choice("xyz") for _ in range(4)) + "suffix"] = rng.choice([5, 25, 125, 625])
    words["a" * 5_000], words["a" * 4_999 + "b"], words["a" * 4_999], words["b" + "a" * 5_000] = 5, 5, 40, 6
    assert shown(variants(table(spark, words), tile=tile)) == brute_variants(words)


def test_near_pairs_are_found_once(spark):
    words = {"".join(x): 5 for x in __import__("itertools").product("ab", repeat=7)} | {"".join(x): 5 for x in __import__("itertools").product("ab", repeat=6)}
    want = {w: sum(one_edit(w, o) for o in words) for w in words}
    assert {r.word: r.n_near for r in near_words(table(spark, words), tile=2).collect()} == want


def test_words_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 30)
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abABéÉ×") for _ in range(rng.choice([1, 5, 6, 7])))
    rows = [(k % 97, rng.choice([" ", "-", "1", "Ā", "\n"]).join(word() for _ in range(60))) for k in range(300)]
    rows += [(None, None), (None, "abcdef " * 7), (1, ""), (2, None), (3, "x" * 3_000), (3, "x" * 3_000), (4, ("x" * 3_000 + " ") * 5), (5, "letter " * 20_000)]
    got = {r.word: r.n for r in word_counts(documents(spark, rows)).collect()}
    want = brute_words(rows)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want if got.get(k) != want.get(k)} == {} and len(got) > 15


def test_empty_table(spark):
    assert variants(word_counts(documents(spark, []).limit(0))).count() == 0


def test_spelling_query(spark, tmp_path):
    rows = [(k, "colour colour colour Colour colour; " + ("color" if k % 2 else "colouur") + " unrelated") for k in range(20)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert shown(got) == brute_variants(brute_words(rows))
