"""Perplexity under a class-based bigram model: exchange clustering, class transitions, word emissions.

Counts come from every training text. Words are 64-bit hashes; the most frequent ``clustered`` words get classes by
exchange (moves that raise the likelihood of the class bigrams). Every other word seen ``least`` times or more, however
many there are, gets the class that its neighbours' classes make most likely. The end of a text has a class of its own,
and the words seen less often, unseen ones included, share one class. The probability of a token is

    (1 - mix) * P(class | class before) * P(word | class)  +  mix * (c + 1) / (N + V + 1)

with smoothed transitions; c is the token's count, N all training tokens, V the distinct ones. Everything that
a task or the driver holds is bounded by ``clustered``, ``classes`` and ``head``; counts and classes of all other
words meet the texts in a join.

A null text is an empty one: one token, the end. Without training texts every token has probability 1. Rows with
equal keys are scored one by one. An empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch

END = int(np.uint64(xxhash.xxh3_64_intdigest(b"\n")).astype(np.int64))  # no word holds white space


def tokens(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = out.view(np.int64)
    out[-1] = END
    return out


def _texts(batches, column: str = "text", most: int = 2_000_000):
    """(first row, texts) in runs of about ``most`` characters."""
    for b in batches:
        texts, at, size = b.column(column).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > most or i + 1 == len(texts):
                yield b, at, texts[at : i + 1]
                at, size = i + 1, 0


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """w (hash) and c of every token of all texts; tasks add up what they have read before anything is shuffled."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            word, at = np.unique(w, return_inverse=True)
            return word, np.bincount(at, weights=c).astype(np.int64)

        for _, _, texts in _texts(batches):
            held.append(np.unique(np.concatenate([tokens(t) for t in texts]), return_counts=True))
            if len(held) > 8:
                held = [merged()]
                if len(held[0][0]) > 1_500_000:
                    yield pa.RecordBatch.from_pydict(dict(zip("wc", held.pop(), strict=True)))
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip("wc", merged(), strict=True)))

    return docs.select(_text(docs, text).alias("text")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Index:
    """Numbers of known hashes; everything else gets the number after the last."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n = len(self.sorted)
        if not n:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), n - 1)
        return np.where(self.sorted[at] == h, self.order[at], n)


def pair_counts(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """a, b, c: how often word number b follows a in the texts; a text starts after an end."""
    known, n = docs.sparkSession.sparkContext.broadcast(index), len(index.sorted) + 1

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            pair, at = np.unique(w, return_inverse=True)
            return pair, np.bincount(at, weights=c).astype(np.int64)

        def out():
            pair, c = merged()
            return pa.RecordBatch.from_pydict({"a": (pair // n).astype(np.int32), "b": (pair % n).astype(np.int32), "c": c})

        for _, _, texts in _texts(batches):
            h = np.concatenate([np.asarray([END]), *(tokens(t) for t in texts)])
            k = known.value(h)
            held.append(np.unique(k[:-1] * n + k[1:], return_counts=True))
            if len(held) > 8:
                held = [merged()]
                if len(held[0][0]) > 1_500_000:
                    yield out()
                    held = []
        if held:
            yield out()

    return docs.select(_text(docs, text).alias("text")).mapInArrow(run, "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: DataFrame, words: int, classes: int, fixed: list[int], rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word number and the class bigram counts.

    pairs: a, b, c over ``words`` numbers. Words in ``fixed`` keep classes of their own, the first ones. In each round
    Spark adds up every word's neighbours by class, and words move, one after another, to the class that gains most.
    """
    spark, free = pairs.sparkSession, classes - len(fixed)
    of = np.empty(words, np.int64)
    rest = np.setdiff1d(np.arange(words), fixed)
    of[fixed] = np.arange(len(fixed))
    of[rest] = len(fixed) + np.arange(len(rest)) % max(1, free)

    def neighbours() -> tuple[np.ndarray, np.ndarray]:
        table = spark.createDataFrame(pa.table({"i": np.arange(words, dtype=np.int32), "k": of.astype(np.int32)}))
        table = F.broadcast(table)  # one row for each clustered word
        after = pairs.join(table, pairs["b"] == table["i"]).groupBy("a", "k").agg(F.sum("c").alias("c")).select(F.col("a").alias("w"), "k", "c", F.lit(0).alias("left"))
        before = pairs.join(table, pairs["a"] == table["i"]).groupBy("b", "k").agg(F.sum("c").alias("c")).select(F.col("b").alias("w"), "k", "c", F.lit(1).alias("left"))
        got = after.union(before).toArrow()  # words x classes x 2 at most
        left, w, k, c = (got.column(x).to_numpy() for x in ("left", "w", "k", "c"))
        out = np.zeros((2, words, classes))
        out[left, w, k] = c
        return out[0], out[1]

    for turn in range(rounds + 1):
        right, left = neighbours()
        n = np.zeros((classes, classes))
        np.add.at(n, of, right)
        if turn == rounds:
            return of, n
        for w in rest[np.argsort(-right[rest].sum(axis=1), kind="stable")].tolist():
            r, c, a = right[w], left[w], of[w]
            n[a] -= r
            n[:, a] -= c
            n = np.maximum(n, 0)
            out_, in_ = n.sum(axis=1), n.sum(axis=0)
            gain = (_f(n + r) - _f(n)).sum(axis=1) + (_f(n + c[:, None]) - _f(n)).sum(axis=0) - (_f(out_ + r.sum()) - _f(out_)) - (_f(in_ + c.sum()) - _f(in_))
            gain[: len(fixed)] = -np.inf
            b = int(gain.argmax()) if free else a
            of[w] = b
            n[b] += r
            n[:, b] += c
    return of, n


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of the most frequent words, at most ``most``: all from the lowest level of counts that still fits."""
    level = F.floor(F.log2("c") * 16)
    floor, fits = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        fits += r["count"]
        if fits > most:
            break
        floor = r["level"]
    top = counts.where(level >= floor).select("w", "c").toArrow() if floor is not None else None
    if top is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w, c = top.column("w").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((w, -c))
    return w[order], c[order]


def neighbours(docs: DataFrame, index: Index, core: int, classed: int, of: np.ndarray, classes: int, beyond: bool, text: str = "text") -> DataFrame:
    """w, side, c: how often a word that isn't in the core stands after (side below ``classes``) or before a class.

    Numbers from ``core`` to ``classed`` are wanted, and with ``beyond`` those that the index doesn't know."""
    sent, n = docs.sparkSession.sparkContext.broadcast((index, of)), len(index.sorted)

    def run(batches):
        held, size = [], 0

        def out():
            w, side = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((side, w))
            w, side = w[order], side[order]
            new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (side[1:] != side[:-1])))
            return pa.RecordBatch.from_pydict({"w": w[new], "side": side[new].astype(np.int32), "c": np.diff(np.append(new, len(w)))})

        known, kind = sent.value
        for _, _, texts in _texts(batches):
            h = np.concatenate([np.asarray([END]), *(tokens(t) for t in texts)])
            at = known(h)
            k = kind[np.minimum(at, core)]
            want = np.flatnonzero((at >= core) & (at < classed) | (at == n if beyond else False))
            held.append((np.tile(h[want], 2), np.concatenate([k[want - 1], classes + k[want + 1]])))
            size += 2 * len(want)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return docs.select(_text(docs, text).alias("text")).mapInArrow(run, "w long, side int, c long")


def assign(near: DataFrame, n: np.ndarray, fixed: int) -> DataFrame:
    """w, k: the class, none of the first ``fixed``, in which each word's neighbours are most likely."""
    classes, soft = len(n), n + 0.1
    gain = np.concatenate([np.log(soft / soft.sum(axis=0)), np.log(soft / soft.sum(axis=1, keepdims=True)).T])

    def run(batches):
        for b in batches:
            near = b.column("near")
            flat = near.flatten()
            x = np.zeros((b.num_rows, 2 * classes))
            row = np.repeat(np.arange(b.num_rows), near.value_lengths().to_numpy(zero_copy_only=False))
            x[row, flat.field("side").to_numpy()] = flat.field("c").to_numpy()
            k = fixed + (x @ gain[:, fixed:]).argmax(axis=1)
            yield pa.RecordBatch.from_pydict({"w": b.column("w"), "k": k.astype(np.int32)})

    by = near.repartition("w").groupBy("w", "side").agg(F.sum("c").alias("c"))
    lists = by.groupBy("w").agg(F.collect_list(F.struct("side", "c")).alias("near"))  # 2 x classes at most
    return lists.mapInArrow(run, "w long, k int")


def _sorted(tail: DataFrame) -> DataFrame:
    return tail.repartition("row").sortWithinPartitions("row", "i")


def _before(b: pa.RecordBatch, k: np.ndarray, last: int) -> np.ndarray:
    """The class before each token of a sorted tail: its own entry, or the class of the token before it in the tail."""
    before = b.column("before").to_numpy()
    return np.where(before >= 0, before, np.append(last, k[:-1]))


def class_pairs(docs: DataFrame, index: Index, of: np.ndarray, classes: int, classed: DataFrame | None, text: str = "text") -> np.ndarray:
    """Class bigram counts of all texts; ``classed`` holds w and k of the words that the index doesn't know."""
    sent, n = docs.sparkSession.sparkContext.broadcast((index, of)), len(index.sorted)
    deep, square = classed is not None, classes * classes

    def known(batches):
        from pyspark import TaskContext

        known, kind = sent.value
        count, nth = np.zeros(square, np.int64), TaskContext.get().partitionId() << 33
        for _, _, texts in _texts(batches):
            h = np.concatenate([np.asarray([END]), *(tokens(t) for t in texts)])
            at = known(h)
            k = kind[np.minimum(at, len(kind) - 1)]
            new = (at == n) & deep
            count += np.bincount((k[:-1] * classes + k[1:])[~(new[:-1] | new[1:])], minlength=square)
            if new.any():
                i, k = np.flatnonzero(new), np.where(new, -1, k)
                row = nth + np.searchsorted(np.flatnonzero(h == END), i)
                yield pa.RecordBatch.from_pydict({"row": row, "i": i, "w": h[i], "before": k[i - 1].astype(np.int32), "after": k[i + 1].astype(np.int32), "c": np.zeros(len(i), np.int64)})
            nth += len(texts) + 1
        at = np.flatnonzero(count)
        none = np.full(len(at), -1)
        yield pa.RecordBatch.from_pydict({"row": none, "i": none, "w": none, "before": (at // classes).astype(np.int32), "after": (at % classes).astype(np.int32), "c": count[at]})

    def joined(batches):
        count, last = np.zeros(square, np.int64), 0
        for b in batches:
            k, after = b.column("k").to_numpy(), b.column("after").to_numpy()
            if len(k):
                count += np.bincount(_before(b, k, last) * classes + k, minlength=square) + np.bincount((k * classes + after)[after >= 0], minlength=square)
                last = k[-1]
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"before": (at // classes).astype(np.int32), "after": (at % classes).astype(np.int32), "c": count[at]})

    rows = docs.select(_text(docs, text).alias("text")).mapInArrow(known, "row long, i long, w long, before int, after int, c long")
    if deep:
        rows = scratch.table(rows, "class_pairs")
        tail = rows.where("row >= 0").join(classed, "w", "left").select("row", "i", "before", "after", F.coalesce("k", F.lit(1)).alias("k"))
        rows = rows.where("row < 0").select("before", "after", "c").unionByName(_sorted(tail).mapInArrow(joined, "before int, after int, c long"))
    out = np.zeros((classes, classes))
    for r in rows.groupBy("before", "after").agg(F.sum("c").alias("c")).collect():  # classes x classes at most
        out[r.before, r.after] = r.c
    return out


@dataclass
class Model:
    total: int
    distinct: int
    head: Index
    head_counts: np.ndarray
    clustered: int  # words of the head with a class of their own choice: the first ones
    of: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # of clustered words; of others without the factor c + 1
    mix: float
    inside: np.ndarray  # tokens of each class
    beyond: DataFrame | None = None  # w, c, k of words beyond the head; never sent to workers

    def log(self, before: np.ndarray, k: np.ndarray, seen: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.log10((1 - self.mix) * self.move[before, k] * seen + self.mix * base)

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """For each text: its tokens; known ones among the head; both scores without what words beyond the head add; where its words beyond
        the head begin among those of all, one end more; and those words with what is around them, ``i`` within their text."""
        each = [tokens(t) for t in texts]
        lengths, h = np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)
        if not self.total:
            none, zero = h[:0], np.zeros(len(each))
            return lengths, zero.astype(np.int64), zero, zero, np.zeros(len(each) + 1, np.int64), {"i": none, "w": none, "before": none, "after": none, "seen": none.astype(float), "c1": none.astype(float)}
        starts = np.cumsum(lengths) - lengths
        at = self.head(h)
        beyond = at == len(self.head_counts) - 1
        c1 = self.head_counts[at] + 1.0
        unit = 1 / (self.total + self.distinct + 1)
        word = np.minimum(at, self.clustered)
        k = self.of[word]
        before, after = np.roll(k, 1), np.roll(beyond, 1)
        before[starts], after[starts] = self.of[self.head(np.asarray([END]))[0]], False
        seen = self.emit[word] * np.where(word == self.clustered, c1, 1.0)
        own, plain = np.zeros(len(h)), ~(beyond | after)
        own[plain] = self.log(before[plain], k[plain], seen[plain], c1[plain] * unit)
        base = np.where(beyond, 0.0, np.log10(self.head_counts + 1.0)[at])
        i = np.flatnonzero(beyond)  # a text's last token is the end, which is known
        ends = np.searchsorted(i, np.append(starts, len(h)))
        within = i - np.repeat(starts, np.diff(ends))
        tail = {"i": within, "w": h[i], "before": np.where(after[i], -1, before[i]), "after": np.where(beyond[i + 1], -1, k[i + 1]), "seen": seen[i + 1], "c1": c1[i + 1]}
        total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token
        return lengths, total((~beyond).astype(np.int64)), total(base) + lengths * np.log10(unit), total(own), ends, tail


def fit(docs: DataFrame, counts: DataFrame, text: str = "text", clustered: int = 4096, classes: int = 64, head: int = 200_000, mix: float = 0.05, rounds: int = 5, least: int = 3) -> Model:
    """docs: the training texts; counts: ``word_counts`` of them, as a table."""
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    if not total:
        return Model(0, 0, Index(np.empty(0, np.int64)), np.zeros(1), 0, np.zeros(1, np.int64), np.ones((1, 1)), np.ones(1), mix, np.zeros(1))
    w, c = most_frequent(counts, head)
    first = np.flatnonzero(w == END)  # the end is always among the clustered
    if len(first):
        order = np.concatenate([first, np.delete(np.arange(len(w)), first)])
    else:
        order, w, c = np.arange(len(w) + 1), np.append(END, w), np.append(counts.where(F.col("w") == END).first().c, c)
    w, c = w[order], c[order]
    m = min(clustered, len(w))
    pairs = scratch.table(pair_counts(docs, Index(w[:m]), text), "pairs")
    kinds = min(classes, m + 1)
    of, n = exchange(pairs, m + 1, kinds, [0, m], rounds)
    index, lowest, free = Index(w), int(c[1:].min()) if len(w) > 1 else 0, kinds > 2
    known = m + int((c[m:] >= least).sum()) if free else m
    deep = free and lowest > least  # words beyond the head have lower counts
    size, number, tail = np.bincount(of[:m], weights=c[:m], minlength=kinds), m, None
    if known > m or deep:
        near = neighbours(docs, index, m, known, of, kinds, deep, text)
        classed = scratch.table(assign(near, n, 2).join(counts.where(F.col("c") >= least), "w").select("w", "c", "k"), "classes")
        for r in classed.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            size[r.k] += r.c
            number += r.n
        top = classed.where(F.col("c") >= lowest).toArrow()  # of the head
        mine = np.empty(len(w) + 1, np.int64)
        mine[index(top.column("w").to_numpy())] = top.column("k").to_numpy()
        of = np.concatenate([of[:m], mine[m:known], [1]])
        tail = classed.where(F.col("c") < lowest).select("w", "k") if deep else None
        n = class_pairs(docs, index, of, kinds, tail, text)
    follows = n.sum(axis=0)
    share = (follows + 1) / (follows.sum() + len(follows))
    move = (n + 5 * share) / (n.sum(axis=1, keepdims=True) + 5)
    emit = np.append(c[:known] / size[of[:known]], 1 / (total - size.sum() + distinct - number + 1))
    beyond = counts.where(F.col("c") < lowest) if len(w) > 1 else counts
    beyond = beyond.join(tail, "w", "left") if tail is not None else beyond.withColumn("k", F.lit(None).cast("int"))
    return Model(int(total), int(distinct), index, np.append(c, 0).astype(np.float64), known, of, move, emit, mix, size, beyond)


def score(docs: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score (log10) of every row, learned where ``train_on`` holds."""
    train = docs.where(train_on)
    counts = scratch.table(word_counts(train, text), "counts")
    model = fit(train, counts, text, **settings)
    words, model.beyond = model.beyond, None
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by head and clustered
    kinds = {"i": pa.int32(), "w": pa.int64(), "before": pa.int32(), "after": pa.int32(), "seen": pa.float64(), "c1": pa.float64()}

    def run(batches):
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId() << 33, 0
        for b, at, texts in _texts(batches):
            n, known, base, own, ends, tail = sent.value.parts(texts)
            flat = pa.StructArray.from_arrays([pa.array(tail[c], kind) for c, kind in kinds.items()], names=list(kinds))
            yield pa.RecordBatch.from_pydict({"key": b.column("key").slice(at, len(texts)), "row": pa.array(range(task + nth, task + nth + len(texts)), pa.int64()), "n": pa.array(n), "known": pa.array(known), "base": pa.array(base), "own": pa.array(own), "tail": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)})
            nth += len(texts)

    def more(batches):
        model, last = sent.value, 0
        unit = 1 / (model.total + model.distinct + 1)
        for b in batches:
            row, seen, c1, after, c = (b.column(x).to_numpy() for x in ("row", "seen", "c1", "after", "c"))
            if not len(row):
                continue
            free = b.column("k").to_numpy()
            k = np.where(free < 0, 1, free)
            own = np.where(free < 0, (c + 1) * model.emit[-1], c / np.maximum(model.inside[k], 1))
            add = model.log(_before(b, k, last), k, own, (c + 1) * unit)
            add += np.where(after >= 0, model.log(k, np.maximum(after, 0), seen, c1 * unit), 0.0)
            last = k[-1]
            new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            yield pa.RecordBatch.from_pydict({"row": row[new], "k": np.add.reduceat((c > 0).astype(np.int64), new), "s": np.add.reduceat(np.log10(c + 1.0), new), "own_s": np.add.reduceat(add, new)})

    rows = docs.select(F.col(key).cast("long").alias("key"), _text(docs, text).alias("text"))
    part = scratch.table(rows.mapInArrow(run, "key long, row long, n long, known long, base double, own double, tail array<struct<i:int,w:long,before:int,after:int,seen:double,c1:double>>"), "parts")
    both = part.drop("tail").withColumns({"k": F.lit(0), "s": F.lit(0.0), "own_s": F.lit(0.0)})
    if words is not None:
        tail = part.select("row", F.inline("tail")).join(words, "w", "left")
        tail = tail.select("row", "i", "before", "after", "seen", "c1", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("k", F.lit(-1)).alias("k"))
        found = _sorted(tail).mapInArrow(more, "row long, k long, s double, own_s double").groupBy("row").agg(*(F.sum(x).alias(x) for x in ("k", "s", "own_s")))
        both = part.drop("tail").join(found, "row", "left")
    add = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("key", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + add("s")).alias("base_score"), (F.col("own") + add("own_s")).alias("score"))
