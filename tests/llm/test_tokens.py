import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from editlore.llm import packing, token_codes, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "text string, doc_id long, key string, id long, size long, _part int, n_tokens long"
ODD = list("ab c\n \n  .,'sSAéßñÀ1%|<>") + ["<|endoftext|>", "\t", "\xa0", "\u2003", "'s", "n't", "日本", "\u0301", "²", "İ", "  ", "\n\n\n", "_", "«", "\x1c", "\x85", "\0"]


def documents(spark, rows):
    return spark.createDataFrame([(t, i, "k", 1, 2, 3, 4) for i, t in rows], DOCS)


@pytest.mark.parametrize("path, kind", [(BYTES, "bytes"), (WORDS, "words")])
def test_ids_equal_the_library(path, kind):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab \nÀ.,") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "\n"]
    texts += ["".join(rng.choice("aTÉß=`',.!&<>µ 9\u0301\u0308") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("aTÉß=`',.!&{>µ 9-") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    coder = tokens.encoder(path, kind)
    wanted = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, got, want in zip(texts, coder.encode(texts), wanted):
        assert got.tolist() == want.ids, repr(text)


def test_cache_overflow_keeps_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    coder = tokens.ByteEncoder(BYTES)
    for text in ("one two three four", "four five six", "one two"):
        assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, kind", [(BYTES, "bytes"), (WORDS, "words")])
def test_words_in_use_survive_a_full_cache(path, kind, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    coder, asked = tokens.Encoder.__subclasses__()[kind == "words"](path), []
    together = coder.together
    monkeypatch.setattr(coder, "together", lambda keys, counts: asked.append(len(keys)) or together(keys, counts))
    text = " ".join(f"often{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100))
    for k in range(9):
        new = " ".join(f"once{'abcdefghij'[k]}{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10]}" for j in range(100))
        assert coder.encode([f"{text} {new}"])[0].tolist() == coder.tokenizer.encode(f"{text} {new}", add_special_tokens=False).ids
    assert sum(asked) <= 1_010  # each word once; texts begin with another key


def test_segment_round_trip():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50_000, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    segment = token_codes.Segment(token_codes.pack_segment([7, 7, 9], [0, 3000, 6], ids))
    assert segment.tokens().tolist() == ids.tolist()
    assert segment.doc_ids.tolist() == [7, 7, 9] and segment.ends.tolist() == [0, 3000, 3006]
    for at in [0, 1, 511, 512, 513, 2999, 3000, 3001, 3002, 3003, 3004, 3005]:
        assert segment.token(at) == ids[at]
    with pytest.raises(IndexError):
        segment.token(3006)
    with pytest.raises(ValueError):
        token_codes.pack_segment([1], [1], np.array([70_000], np.uint32), (1, 1))


def test_codes_in_document_order(spark):
    texts = [(5, "five five"), (3, None), (1, "A long " * 4000), (9, ""), (5, "five five"), (-2, "minus")]
    segments = token_codes.write_codes(documents(spark, texts), WORDS, 2, segment_tokens=50)
    got = sorted(tuple(r) for r in token_codes.read_documents(segments).collect())
    coder, start, want, flat = tokens.encoder(WORDS, "words"), 0, [], []
    for i, text in sorted(texts, key=lambda x: x[0]):
        ids = np.append(coder.encode([text or ""])[0], 2).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        flat += ids.tolist()
    assert got == sorted(want)
    places = [0, 1, 5, len(flat) - 1, 4001, len(flat), -1]
    read = token_codes.read_tokens(segments, spark.createDataFrame([(p,) for p in places], "position int"), 50)
    assert {r.position: r.token for r in read.collect()} == {p: flat[p] for p in places if 0 <= p < len(flat)}


def test_codes_without_ids(spark):
    segments = token_codes.write_codes(documents(spark, [(None, "a"), (1, "b c"), (None, None)]), WORDS, 2)
    assert [(r.doc_id, r.n_tokens) for r in token_codes.read_documents(segments).orderBy("start").collect()][2] == (1, 3)
    assert {r.doc_id for r in token_codes.read_documents(segments).collect()} == {None, 1}


def test_codes_of_nothing(spark):
    assert token_codes.read_documents(token_codes.write_codes(documents(spark, []), WORDS, 2)).collect() == []


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces(spark):
    rows = packing.token_pieces(documents(spark, [(1, "a b c d e f g"), (2, None), (3, "")]), BYTES, 0, 3).orderBy("doc_id", "piece").collect()
    ids = np.append(tokens.encoder(BYTES, "bytes").encode(["a b c d e f g"])[0], 0).astype("<u4")
    first = [r for r in rows if r.doc_id == 1]
    assert [(r.piece, r.start, r.length) for r in first] == [(0, 0, 2), (1, 2, 3), (2, 5, 3)]
    assert [r.ids_crc32 for r in first] == [zlib.crc32(ids[a:b].tobytes()) for a, b in ((0, 2), (2, 5), (5, 8))]
    assert [r.length for r in rows if r.doc_id != 1] == [1, 1]


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed, low, high", [(1, 1, 100), (2, 30, 60), (3, 1, 5), (4, 50, 100), (5, 51, 51), (6, 1, 1)])
def test_packing_is_tight(spark, seed, low, high, monkeypatch):
    rng = random.Random(seed)
    lengths = [rng.randint(low, high) for _ in range(600)]
    monkeypatch.setattr(packing.common, "few", lambda spark, rows: 5)  # matches must cross partitions
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.best_fit(pieces, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600)) and all(r.length == lengths[r.doc_id] for r in rows)
    assert check_packed(rows, 100) <= best_fit_decreasing(lengths, 100) * 1.03 + 1


@pytest.mark.parametrize("capacity, low, high, n", [(100, 1, 100, 3_000), (100, 1, 5, 3_000), (64, 20, 40, 500), (2048, 1, 2047, 2_000), (7, 1, 6, 50)])
def test_counted_packing_equals_best_fit_decreasing(spark, capacity, low, high, n, monkeypatch):
    rng = random.Random(capacity + high)
    lengths = [rng.randint(low, high) for _ in range(n)]
    tables = []
    stored = packing.common.stored
    monkeypatch.setattr(packing.common, "stored", lambda df: tables.append(df) or stored(df))
    pieces = spark.createDataFrame([(i, 0, 0, x, 0) for i, x in enumerate(lengths)], packing.PIECES)
    rows = packing.best_fit(pieces, capacity, 3).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert check_packed(rows, capacity) == best_fit_decreasing(lengths, capacity)
    assert len(tables) == 1  # no rounds


def test_runs_do_not_grow_with_pieces():
    one = packing.runs({size: 1_000 + size * 7 % 513 for size in range(1, 2048)}, 2048)
    many = packing.runs({size: 1_000_003 * (1_000 + size * 7 % 513) for size in range(1, 2048)}, 2048)
    assert max(len(one), len(many)) < 2 * 2048 * 11 and packing.runs({}, 2048).shape == (0, 5)


def test_packing_unties_bundles(spark):
    lengths = [60] * 40 + [1] * 400  # bundles of 16 fit into no gap of 4
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.best_fit(pieces, 64, 4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(440)) and all(r.length == lengths[r.doc_id] for r in rows)
    assert check_packed(rows, 64) == 44  # 2,800 / 64


def test_packing_nothing_and_full_pieces(spark):
    assert packing.best_fit(spark.createDataFrame([], packing.PIECES)).collect() == []
    rows = packing.best_fit(spark.createDataFrame([(1, 0, 0, 8, 0), (1, 0, 0, 8, 0), (2, 0, 0, 8, 0)], packing.PIECES), 8).collect()
    assert check_packed(rows, 8) == 3
