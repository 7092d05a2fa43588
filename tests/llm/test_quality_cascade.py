from collections import Counter

from pyspark.sql import functions as F

from deskloom.llm import quality_cascade as qc
from .conftest import frame

BLANK = " \t\n\x0b\x0c\r"


def figures(t):
    t = t or ""
    words = t.encode().split()
    words = [w.decode() for w in words]
    lines = [x for x in t.split("\n") if x.strip(BLANK)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(inside))


def rejected(f):
    n, chars, symbols, lines, dup, rep = f
    return n < 20 or 100 * rep > 30 * n or 100 * symbols > 40 * n or (lines >= 4 and 2 * dup > lines) or chars < 2 * n or chars > 20 * n


TEXTS = ["a b c d e f g h " * 5, "x " * 7, "x " * 8, "x " * 9, "same line here\n" * 9 + "other", "# * $ " * 20, "word " * 3 + "\x0b\x1c w\x85w\xa0x ", "é日👍 " * 30]


def test_figures_and_verdicts(spark, made):
    rows = made + [(200 + i, t) for i, t in enumerate(TEXTS)]
    got = qc.scored(frame(spark, rows).withColumn("n_words", F.lit("own")), prefix="m_").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *(r[f"m_{x}"] for x in names), r.rejected_by is not None) for r in got), key=repr) == sorted(((k, *figures(t), rejected(figures(t))) for k, t in rows), key=repr)
    assert {r.n_words for r in got} == {"own"}  # a clashing column stays
    lazy = qc.cascade(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.rejected_by is None) for r in lazy), key=repr) == sorted(((k, not rejected(figures(t))) for k, t in rows), key=repr)


def test_order_follows_rejection_per_cost(spark, made):
    """Each rule in turn rejects most per work of all that are left, among the rows that the earlier ones let pass; two runs agree."""
    docs = frame(spark, made)
    order = qc.estimate(docs)
    assert order == qc.estimate(docs) and {n for n, _, _ in order} == set(qc.STANDARD)
    texts, hits = [t for _, t in made], {n: lambda f, n=n: bool(rule_hits(f)[n]) for n in qc.STANDARD}
    left, had = [figures(t) for t in texts], set()
    chars, words = sum(len(t or "") for t in texts) / len(texts) + 1, sum(figures(t)[0] for t in texts) / len(texts) + 1
    for name, work, share in order:
        def of(n):
            cost = [qc.PARTS[x][:2] if x in qc.PARTS else qc.FIGURES[x][1:3] for x in qc.needs(qc.STANDARD[n]) if x not in had]
            return 1 + sum(c * chars + w * words for c, w in cost), sum(map(hits[n], left)) / max(1, len(left))
        rest = [n for n, _, _ in order[[n for n, _, _ in order].index(name) :]]
        assert abs(of(name)[0] - work) < 1e-6 and abs(of(name)[1] - share) < 1e-9
        assert all(share / work >= of(n)[1] / of(n)[0] - 1e-12 for n in rest)
        left, had = [f for f in left if not hits[name](f)], had | set(qc.needs(qc.STANDARD[name]))


def rule_hits(f):
    n, chars, symbols, lines, dup, rep = f
    return {"few_words": n < 20, "repeats": 100 * rep > 30 * n, "symbols": 100 * symbols > 40 * n, "duplicate_lines": lines >= 4 and 2 * dup > lines, "short_words": chars < 2 * n, "long_words": chars > 20 * n}


def test_cascade_skips_what_no_rule_needs_any_more(spark, monkeypatch):
    """A figure that fails when computed isn't computed for rows that an earlier rule rejects."""
    monkeypatch.setitem(qc.FIGURES, "fails", ("", 0, 1e9, lambda t: F.raise_error(F.concat(F.lit("computed for "), t)).cast("long")))
    rules = {"few_words": qc.STANDARD["few_words"], "late": lambda m: m("fails") > 0}
    monkeypatch.setattr(qc, "estimate", lambda *a, **k: [("few_words", 1, 1), ("late", 1, 1)])
    assert {r.rejected_by for r in qc.cascade(frame(spark, [(1, "x"), (2, None)]), rules=rules).collect()} == {"few_words"}


def test_later_rules_are_not_computed_for_rejected_texts(spark):
    made = {"cheap": F.col("doc_id") > 0, "fails": F.raise_error(F.lit("computed")).isNull()}
    got = frame(spark, [(1, "x"), (2, None)]).select(qc.verdict(["cheap", "fails"], made).alias("v")).collect()
    assert [r.v for r in got] == ["cheap", "cheap"]


def test_empty_table(spark):
    assert qc.cascade(frame(spark, [])).count() == 0
