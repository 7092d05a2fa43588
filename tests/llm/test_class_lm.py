import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deskloom.llm import class_lm as lm
from .conftest import frame


def tok(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def run(spark, rows, train, **kw):
    return lm.score(frame(spark, rows), train, clustered=64, classes=8, rounds=2, **kw).collect()


def test_base_score_and_counts(spark, made):
    train = F.coalesce(F.pmod("doc_id", F.lit(3)) != 1, F.lit(True))
    c = Counter(w for k, t in made if k is None or k % 3 != 1 for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((k, len(tok(t)), sum(w in c for w in tok(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for k, t in made), key=repr)
    for head in (200_000, 70):
        got = run(spark, made, train, head=head)
        assert sorted(((r.key, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=repr) == want
        assert {r.train_tokens for r in got} == {n}


def test_probabilities_sum_to_one(spark, made):
    docs = frame(spark, made)
    counts = lm.scratch.table(lm.word_counts(docs), "c")
    m = lm.fit(docs, counts, clustered=64, classes=8, rounds=2)
    words = {w for _, t in made for w in tok(t)} - {b"\n"}
    c = Counter(w for _, t in made for w in tok(t))
    for before in ("", "one ", "neverseen "):
        start = m.parts([before.strip()])
        p = 0.0
        for w in [*sorted(words), b"unseen-word"]:
            # the probability of w after ``before``: what the text with w has more, its own end left out
            one, two = m.parts([before + w.decode("utf-8")]), None
            h = lm.tokens(before + w.decode("utf-8"))[:-1]
            k = m.of[min(int(m.head(h[-1:])[0]), m.clustered)]
            prev = m.of[min(int(m.head(h[-2:-1] if len(h) > 1 else lm.np.asarray([lm.END]))[0]), m.clustered)]
            seen = m.emit[min(int(m.head(h[-1:])[0]), m.clustered)]
            rare = int(m.head(h[-1:])[0]) >= m.clustered
            p += (1 - m.mix) * m.move[prev, k] * seen * (c[w] + 1 if rare else 1) + m.mix * (c[w] + 1) / (m.total + m.distinct + 1)
            assert one[0][0] == len(h) + 1 and start and two is None
        end = m.of[int(m.head(lm.np.asarray([lm.END]))[0])]
        p += (1 - m.mix) * m.move[prev, end] + m.mix * (c[b"\n"] + 1) / (m.total + m.distinct + 1)
        assert abs(p - 1) < 1e-9


@pytest.mark.parametrize("head", [200_000, 5])
def test_scores_like_a_loop_over_tokens(spark, made, head):
    """The whole score, token by token in plain Python, from what the model says of classes; with words beyond the head too."""
    import math

    docs = frame(spark, [*made, (None, None), (77, "x"), (77, "x never seen x " * 40)])
    counts = lm.scratch.table(lm.word_counts(docs.where("doc_id < 5")), "c")
    m = lm.fit(docs.where("doc_id < 5"), counts, head=head, clustered=4, classes=6, rounds=2)
    c = {r.w: r.c for r in counts.collect()}
    k_of = {} if m.beyond is None else {r.w: r.k for r in m.beyond.collect()}
    size = dict(enumerate(m.inside))

    def log_p(h):
        total, before = 0.0, int(m.of[int(m.head(lm.np.asarray([lm.END]))[0])])
        for w in h.tolist():
            at, n = int(m.head(lm.np.asarray([w]))[0]), c.get(w, 0)
            if at < m.clustered:
                k, emit = int(m.of[at]), float(m.emit[at])
            elif k_of.get(w) is not None:
                k, emit = int(k_of[w]), n / max(size[int(k_of[w])], 1)
            else:
                k, emit = 1, (n + 1) * float(m.emit[-1])
            total += math.log10((1 - m.mix) * float(m.move[before, k]) * emit + m.mix * (n + 1) / (m.total + m.distinct + 1))
            before = k
        return total

    got = lm.score(docs, F.col("doc_id") < 5, head=head, clustered=4, classes=6, rounds=2).collect()
    want = [log_p(lm.tokens(r.text or "")) for r in docs.collect()]
    assert len(got) == len(want) and all(abs(a - b) < 1e-8 for a, b in zip(sorted(r.score for r in got), sorted(want), strict=True))


def test_classes_help(spark):
    rows = [(i, " ".join(f"{'a' if (i + j) % 2 else 'b'}{(i * j) % 9}" for j in range(30))) for i in range(60)]
    got = run(spark, rows, F.col("doc_id") % 5 != 0)
    held = [r for r in got if r.key % 5 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    assert [(r.n_tokens, r.base_score, r.score) for r in run(spark, [(1, "x y")], F.lit(False))] == [(3, 0.0, 0.0)]
    assert run(spark, [], F.lit(True)) == []


def test_words_beyond_the_core_get_classes(spark):
    """Twenty common words and many rarer ones that take turns: a word's class tells what follows."""
    rows = [(i, " ".join(f"{'ab'[j % 2]}{(i * 7 + j * j) % (4 if j % 3 else 120)}" for j in range(80))) for i in range(120)]
    docs, train = frame(spark, rows), F.col("doc_id") % 5 != 0
    counts = lm.scratch.table(lm.word_counts(docs.where(train)), "c")
    c = Counter(w for k, t in rows if k % 5 for w in tok(t))
    m = lm.fit(docs.where(train), counts, clustered=9, classes=6)
    assert m.clustered >= sum(n >= 3 for n in c.values()) > 9
    assert (m.of[1 : m.clustered] > 1).all() and set(m.of[:1]) == {0}
    got = {}
    for head in (200_000, 20):  # the words beyond a small head get the same classes and scores by joins
        got[head] = {r.key: r for r in lm.score(docs, train, clustered=9, classes=6, head=head).collect()}
    assert all(abs(got[20][k].score - r.score) < 1e-9 and got[20][k].n_known == r.n_known for k, r in got[200_000].items())
    held = [r for k, r in got[200_000].items() if k % 5 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_round_revisits_every_word(spark, monkeypatch):
    seen, real = [], lm._f
    monkeypatch.setattr(lm, "_f", lambda x: seen.append(1) or real(x))
    pairs = spark.createDataFrame([(a, b, 1 + a * b) for a in range(8) for b in range(8)], "a int, b int, c long")
    lm.exchange(pairs, 8, 4, [0, 7], rounds=3)
    assert len(seen) == 3 * 6 * 8  # rounds, words, terms of a gain
