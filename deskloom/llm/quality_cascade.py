"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule rejects a text by figures that are plain columns; some figures share a part, such as the array of words. On a sample of
about ``sample_rows`` rows, drawn from the whole table, each rule's cost is counted (the work of the parts and figures that it needs and
that no earlier rule has made, by the sample's characters and words) and its selectivity (share rejected of the rows that reach it). The next rule is
always the one that rejects most per cost, so the order is the same in each run over the same table. The cascade is one nested expression, in
which each part and figure is computed once, where the first rule that needs it is reached, and not at all for texts that an earlier rule rejects;
a filter on the verdict that the optimizer moves to the scan takes it along whole.
The order changes what a run costs, never which texts are rejected, only by which rule.

A null text has no words. A text without words or lines has 0 for each figure. Repeated rows are judged one by one;
other columns pass through, also where a figure has the same name: figures get a prefix of their own. A column with the name
``out`` is replaced by the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

Metric = Callable[[str], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def n_repeat_words(words: Column) -> Column:
    """Words inside any window of 8 that occurs twice or more, by 64-bit hashes of words and of windows."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        step = F.transform(starts, lambda p, i: F.when(i + 1 == n, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(same, lambda e: e["p"]))

        return let(let(pairs, starts), covered)

    def by_words(words: Column) -> Column:
        return let(F.transform(words, lambda x: F.xxhash64(x)), by_hashes)

    def by_hashes(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))
        return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(some)

    return let(words, by_words)


def _rest(text: Column, drop: str) -> Column:
    return F.length(F.translate(text, drop, ""))


# parts and figures: what each needs, work for each character of a text, work for each word of it, column
PARTS: dict[str, tuple[float, float, Callable[[Column], Column]]] = {
    "words": (4, 2, word_array),
    "lines": (2, 0, lambda t: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")),
}
FIGURES: dict[str, tuple[str, float, float, Callable[[Column], Column]]] = {
    "n_words": ("words", 0, 0, F.size),
    "word_chars": ("", 1, 0, lambda t: _rest(t, BLANKS)),
    "n_symbols": ("", 1, 0, lambda t: F.length(t) - _rest(t, SYMBOLS)),
    "n_lines": ("lines", 0, 0, F.size),
    "n_dup_lines": ("lines", 0.5, 0, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
    "n_repeat_words": ("words", 0, 60, n_repeat_words),
}

# Integer arithmetic, so that any engine agrees; true where a text is to be rejected.
Rules = dict[str, Callable[[Metric], Column]]
STANDARD: Rules = {
    "few_words": lambda m: m("n_words") < 20,
    "repeats": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "symbols": lambda m: 100 * m("n_symbols") > 40 * m("n_words"),
    "duplicate_lines": lambda m: (m("n_lines") >= 4) & (2 * m("n_dup_lines") > m("n_lines")),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 20 * m("n_words"),
}


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def needs(rule: Callable[[Metric], Column]) -> list[str]:
    """Parts, then figures, that a rule reads."""
    read: list[str] = []
    rule(lambda name: read.append(name) or F.lit(0).cast("long"))
    read = list(dict.fromkeys(read))
    return list(dict.fromkeys([FIGURES[x][0] for x in read if FIGURES[x][0]])) + read


def with_figure(docs: DataFrame, name: str, text: str, prefix: str) -> DataFrame:
    """``docs`` with a part or figure as one more column."""
    if name in PARTS:
        return docs.withColumn(prefix + name, PARTS[name][2](_text(text)))
    part, *_, build = FIGURES[name]
    return docs.withColumn(prefix + name, build(F.col(prefix + part) if part else _text(text)).cast("long"))


def estimate(docs: DataFrame, text: str = "text", rules: Rules = STANDARD, sample_rows: int = 400) -> list[tuple[str, float, float]]:
    """(rule, its work on a text, share rejected of the texts that reach it), in the order in which the rules are to run."""
    rows = docs.count()
    held = docs.select(F.col(text).cast("string").alias("text")).sample(min(1.0, sample_rows / max(1, rows)), seed=7)
    for name in dict.fromkeys(x for r in rules.values() for x in [*needs(r), "words"]):
        held = with_figure(held, name, "text", "__")
    hit = [F.coalesce(r(lambda k: F.col(f"__{k}")), F.lit(False)).alias(n) for n, r in rules.items()]
    found = held.groupBy(*hit).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("__words")).alias("words")).collect()  # at most one row for each set of rules
    total = max(1, sum(r["rows"] for r in found))
    chars, words = (sum(r[c] or 0 for r in found) / total + 1 for c in ("chars", "words"))
    made, order, left = set(), [], [(r["rows"], {n for n in rules if r[n]}) for r in found]

    def work(name: str) -> float:
        cost = [PARTS[x][:2] if x in PARTS else FIGURES[x][1:3] for x in needs(rules[name]) if x not in made]
        return 1 + sum(c * chars + w * words for c, w in cost)

    while len(order) < len(rules):
        reach = sum(n for n, _ in left)
        share = {r: sum(n for n, hits in left if r in hits) / max(1, reach) for r in rules if r not in [x for x, _, _ in order]}
        best = min(share, key=lambda r: (-share[r] / work(r), work(r), r))
        order.append((best, work(best), share[best]))
        made |= set(needs(rules[best]))
        left = [(n, hits) for n, hits in left if best not in hits]
    return order


def verdict(order: list[str], made: dict[str, Column]) -> Column:
    """The first rule in order that rejects, or null; later rules aren't computed for a rejected text."""
    out = None
    for name in order:
        out = F.when(made[name], F.lit(name)) if out is None else out.when(made[name], F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def first_hit(order: list[str], rules: Rules, text: Column) -> Column:
    """The first rule in order that rejects, or null, as one expression: a part or figure is computed where the first rule that needs it is reached."""

    def rule(i: int, made: dict[str, Column]) -> Column:
        if i == len(order):
            return F.lit(None).cast("string")
        return bound([x for x in needs(rules[order[i]]) if x not in made], i, made)

    def bound(missing: list[str], i: int, made: dict[str, Column]) -> Column:
        if not missing:
            return F.when(rules[order[i]](made.__getitem__), F.lit(order[i])).otherwise(rule(i + 1, made))
        x = missing[0]
        value = PARTS[x][2](text) if x in PARTS else FIGURES[x][3](made[FIGURES[x][0]] if FIGURES[x][0] else text).cast("long")
        return let(value, lambda v: bound(missing[1:], i, made | {x: v}))

    return rule(0, {})


def cascade(docs: DataFrame, text: str = "text", rules: Rules = STANDARD, out: str = "rejected_by") -> DataFrame:
    """``docs`` with the name of the rule that rejects each row (null: none does)."""
    order = [name for name, _, _ in estimate(docs, text, rules)]
    return docs.withColumn(out, first_hit(order, rules, _text(text)))


def scored(docs: DataFrame, text: str = "text", prefix: str = "quality_", rules: Rules = STANDARD, out: str = "rejected_by") -> DataFrame:
    """``docs`` with every figure and the verdict over those figures."""
    order, held = [name for name, _, _ in estimate(docs, text, rules)], docs
    for x in [*PARTS, *FIGURES]:
        held = with_figure(held, x, text, prefix)
    made = {n: r(lambda k: F.col(prefix + k)) for n, r in rules.items()}
    return held.drop(*(prefix + x for x in PARTS)).withColumn(out, verdict(order, made))
