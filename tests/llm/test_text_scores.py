import random

import numpy as np
import pytest

from editlore.llm import common, quality, toxicity

DOCS = "doc_id long, text string, score double, _label int, _id long, label string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, 7, 1, "x") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice("tion ereth ingly thou ofan heres nder outh blere stand".split()) + rng.choice(["", "", "", ","]) for _ in range(n)) + "."


def corpus(n, bad, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        label = i % 2
        if label == bad[0]:
            lines = bad[1](rng, lines)
        rows.append((i, "\n".join(lines), label))
    return rows


def shout(rng, lines):
    return [lines[0]] + [line.upper().replace(" ", "!! ") for line in lines] * 2


def insult(rng, lines):
    return [line.replace(" ", f" {rng.choice(['zorkle', 'vraxen', 'quolth'])} ", 2) for line in lines]


@pytest.mark.parametrize("module, column, bad", [(quality, "quality", (0, shout)), (toxicity, "toxic", (1, insult))])
def test_held_out_accuracy(spark, module, column, bad):
    rows = corpus(400, bad)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")
    model = module.trained(docs, labels)
    scored = module.score(docs, model).withColumn("held", common.fold("doc_id", module.FOLDS) == module.HELD_OUT).collect()
    truth = {i: y for i, _, y in rows}
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == 400
    held = [r for r in scored if r.held]
    assert np.mean([(r.score >= module.CUT) == truth[r.doc_id] for r in held]) > 0.95
    sample = common.labelled(docs, labels, column, 1000, module.FOLDS, module.HELD_OUT)
    assert len(sample) == 400 - len(held)
    assert len(common.labelled(docs, labels, column, 10, module.FOLDS, module.HELD_OUT)) <= 20


@pytest.mark.parametrize("module, bad", [(quality, (0, shout)), (toxicity, (1, insult))])
def test_scores_of_odd_texts(spark, module, bad):
    rows = corpus(200, bad)
    model = module.fit([(t, y) for _, t, y in rows])
    odd = ["", "\n\n\n", " ", "x", "word " * 50_000, rows[0][1], rows[0][1], "é\n\tß  \r\n", "\0\x01"]
    alone = [float(module.Model.scores(model, [t])[0]) for t in odd]
    assert np.allclose(model.scores(odd), alone) and all(0 <= s <= 1 for s in alone)
    docs = documents(spark, [(i, t) for i, t in enumerate(odd)] + [(99, None), (99, None), (None, "x")])
    out = module.score(docs, model, "score")
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(odd) + 3
    empty = {r.score for r in out.filter("text is null or text = ''").collect()}
    assert len(empty) == 1
    assert module.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("module, value", [(quality, 0.5), (toxicity, 0.0)])
def test_no_labels(spark, module, value):
    docs = documents(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(docs, module.trained(docs, labels)).collect()} == {value}
    assert module.trained(docs.limit(0), labels.limit(0)) is None


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    doc = np.array([0, 0, 0, 1, 2, 2])
    node, pair = rng.normal(size=6), rng.normal(size=(2, 2))
    p, joint = quality.marginals(node, doc, pair, both=True)
    want, pairs = np.zeros(6), np.zeros((2, 2))
    for d in range(3):
        rows = np.flatnonzero(doc == d)
        weights = {}
        for code in range(2 ** len(rows)):
            y = [(code >> k) & 1 for k in range(len(rows))]
            weights[tuple(y)] = np.exp(sum(node[r] * v for r, v in zip(rows, y)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        for y, w in weights.items():
            want[rows] += np.array(y) * w / total
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / total
    assert np.allclose(p, want) and np.allclose(joint, pairs)


def test_toxic_runs_stay_inside_words():
    toxic = [toxicity.normal(f"the zorkle {k} and") for k in range(20)]
    ordinary = [toxicity.normal(f"the other {k} and") for k in range(20)]
    assert set(toxicity.toxic_runs(toxic, ordinary)) == {b" zorkle"}


def test_rare_and_short_toxic_words_are_learned():
    rng = random.Random(2)
    texts = [(prose(rng, 40), 0) for _ in range(2400)] + [(prose(rng, 40).replace(" ", f" {'skrelm' if k < 16 else 'zok' if k < 400 else 'vraxen'} ", 2), 1) for k in range(2400)]
    model = toxicity.fit(texts)  # 16 of 2,400 toxic texts have the rare word
    assert all(word in model.toxic for word in (b" skrelm", b" zok\x01zok", b" vraxen"))
    low, *high = model.scores([prose(rng, 40)] + [prose(rng, 40).replace(" ", f" {word} ", 2) for word in ("skrelm", "zok", "vraxen")])
    assert low < toxicity.CUT <= min(high)


def test_all_toxic_runs_are_in_reach():
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(10)) for _ in range(3000)]
    ordinary = (b"tion thou, nder, ingly ereth " * 300)[:toxicity.ORDINARY_BYTES]
    pair = toxicity._compressors(ordinary, b"\0".join(b" " + w.encode() for w in words))
    missed = [w for w in words if toxicity.gains(toxicity.normal(f"tion nder ingly ereth thou {w} ingly thou, nder ingly"), *pair)[1] <= 0]
    assert missed == []


def test_every_distinctive_run_is_in_the_dictionary():
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(10)) for _ in range(1000)]
    texts = [(prose(rng, 80), 0) for _ in range(1000)] + [(" ".join(words[k * 20 % 1000:k * 20 % 1000 + 20]), 1) for k in range(1000)]
    model = toxicity.fit(texts)
    assert len(model.toxic) > 8_000 and set(toxicity.toxic_runs([toxicity.normal(t) for k, (t, y) in enumerate(texts) if y and k % 4 < 3], [toxicity.normal(t) for k, (t, y) in enumerate(texts) if not y and k % 4 < 3])) == set(model.toxic.split(b"\0"))


def test_stages_filter(spark, tmp_path):
    rows = corpus(200, (0, shout))
    spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = quality.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i, _, y in rows if y}) > 95 and len(ids & {i for i, _, y in rows if not y}) < 5
    assert toxicity.toxicity_stage(spark, docs, str(tmp_path)).count() == 200
