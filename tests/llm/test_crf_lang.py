import random

import numpy as np
from pyspark.sql import functions as F

from deskloom.llm import crf_lang as crf
from .conftest import frame

PARTS = {"en": "the ing th er on at".split(), "de": "sch ung ich der ver ei".split(), "fr": "eau oux ére que elle ion".split()}


def say(r, lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    r = random.Random(1)
    return [(i, say(r, lang, r.randint(5, 40)), lang) for i in range(90) for lang in [list(PARTS)[i % 3]]]


def test_held_out_accuracy(spark):
    docs = frame(spark, rows())
    model = crf.fit(docs, F.col("doc_id") % 4 != 0)
    got = {r.key: r for r in crf.predict(docs, model).collect()}
    held = [(k, lang) for k, _, lang in rows() if k % 4 == 0]
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words(spark):
    model = crf.fit(frame(spark, rows()), F.lit(True))
    r = random.Random(7)
    text = say(r, "en", 12) + " " + say(r, "de", 12)
    words = crf.label_words(frame(spark, [(1, text)]), model).first().words
    good = sum(w.lang == ("en" if i < 12 else "de") for i, w in enumerate(words))
    assert len(words) == 24 and good >= 21


def test_forward_backward_equals_all_paths():
    r = np.random.default_rng(3)
    k, lengths = 3, np.asarray([4, 1, 3])
    emit, move, begin = r.normal(size=(8, k)), r.normal(size=(k, k)), r.normal(size=k)
    moves = np.zeros((k, k))
    got = crf.posteriors(emit, lengths, move, begin, moves)
    want, wanted = np.zeros((8, k)), np.zeros((k, k))
    for s, n in zip((0, 4, 5), lengths):
        total, node, pair = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in np.ndindex(*([k] * n)):
            w = np.exp(begin[path[0]] + sum(emit[s + i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, p in enumerate(path):
                node[i, p] += w
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        want[s : s + n] = node / total
        wanted += pair / total
    assert np.allclose(got, want) and np.allclose(moves, wanted)


def test_prediction_like_a_plain_forward_pass(spark):
    """Language and score of whole documents, by sums over paths in plain Python."""
    model = crf.fit(frame(spark, rows()), F.lit(True))
    r = random.Random(9)
    texts = [say(r, "en", 3), say(r, "de", 7) + " 12 -- " + say(r, "fr", 9), say(r, "fr", 60), "ein", "the\n\ncat " * 20]
    got = {x.key: x for x in crf.predict(frame(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        e = [list(map(float, row)) for row in model.emissions(crf.words(t)).astype(np.float32)]
        k = range(len(model.languages))
        a = [[float(model.begin[j]) + e[0][j] for j in k]]
        for row in e[1:]:
            a.append([row[j] + float(np.logaddexp.reduce([a[-1][h] + float(model.move[h, j]) for h in k])) for j in k])
        b = [[0.0 for _ in k]]
        for row in reversed(e[1:]):
            b.insert(0, [float(np.logaddexp.reduce([float(model.move[h, j]) + row[j] + b[0][j] for j in k])) for h in k])
        whole = float(np.logaddexp.reduce(a[-1]))
        mean = [sum(np.exp(x[j] + y[j] - whole) for x, y in zip(a, b, strict=True)) / len(e) for j in k]
        assert got[i].lang_pred == model.languages[int(np.argmax(mean))] and abs(got[i].score - max(mean)) < 1e-5


def test_ids_files_and_order_do_not_decide_what_is_learned(spark):
    some = rows()
    other = [(1000 - 7 * i, t, lang) for i, t, lang in reversed(some)]
    models = [crf.fit(frame(spark, x).repartition(n), F.lit(True), per_language=10) for x, n in ((some, 1), (other, 5))]
    words = crf.words("the cat schung eaux")
    assert models[0].languages == models[1].languages and np.array_equal(models[0].emissions(words), models[1].emissions(words))
    one = crf.fit(frame(spark, [(i, "ein und der ich", "de") for i in range(3000)] + some), F.lit(True), per_language=10)
    assert set(one.languages) == {"en", "de", "fr"}


def test_null_empty_and_unlettered(spark, made):
    model = crf.fit(frame(spark, rows()), F.lit(True))
    odd = [(1, None), (2, ""), (3, "1234 !!! 👍"), (4, "éé"), (4, "éé"), (None, "the ing")]
    got = sorted(((r.key, r.lang_pred, r.score) for r in crf.predict(frame(spark, odd), model).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, "und", 0.0) for i in (1, 2, 3)]
    assert len(got) == 6 and all(lang in PARTS for k, lang, _ in got if k in (4, None))
    assert crf.predict(frame(spark, []), model).count() == 0
    assert {r.lang_pred for r in crf.predict(frame(spark, made), crf.train([])).collect()} == {"und"}
    kept = crf.keep_identified(frame(spark, odd), model)
    assert kept.columns == frame(spark, odd).columns and {r.doc_id for r in kept.collect()} <= {4, None}


def test_long_runs_are_read_to_their_end(spark):
    assert b"".join(crf.words("a" + "日本é" * 90)) == ("a" + "日本é" * 90).encode()
    assert all(w.decode() and len(w) <= crf.LONGEST for w in crf.words("a" + "日本é" * 90))
    model = crf.fit(frame(spark, rows()), F.lit(True))
    r = random.Random(5)
    run = say(r, "en", 8).replace(" ", "")[:60] + say(r, "de", 150).replace(" ", "")
    assert crf.predict(frame(spark, [(1, run)]), model).first().lang_pred == "de"


def test_code_switched_texts_are_kept(spark):
    model = crf.fit(frame(spark, rows()), F.lit(True))
    r = random.Random(9)
    docs = frame(spark, [(i, " ".join(say(r, lang, 20) for lang in (PARTS if i % 2 else ("en", "de")))) for i in range(12)])
    assert min(x.score for x in crf.predict(docs, model).collect()) < 0.5  # no language has half of each text
    assert crf.keep_identified(docs, model).count() == 12


def test_texts_are_kept_without_a_model(spark):
    docs = frame(spark, [(1, "some words"), (2, "1234 !!"), (3, None)])
    assert [r.doc_id for r in crf.keep_identified(docs, crf.train([])).collect()] == [1]
