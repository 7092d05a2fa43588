"""Language identification by a linear-chain conditional random field over words.

A word's score for each language is the sum of learned weights of its affixes, its character n-grams and the word
itself (the lexicon), all hashed to one table; learned transitions join neighbouring words. Forward-backward gives
each word's probability of each language, so that code-switched texts get labels word by word; a text's language is
the one with the largest mean probability, and its score is that mean.

Training uses a bounded sample: about ``per_language`` labelled rows of each of the ``most_languages`` commonest languages, drawn row by row
whatever their keys and texts, from each at most six short
passages spread over the whole text, spliced into code-switched sequences so that transitions are learned too.

A text that is null or has no letter is ``und`` with score 0; words without letters take no part. With no labelled
row every text is ``und``. Ties go to the language that sorts first. Repeated rows and keys stay as they are.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .held import held

BUCKETS = 1 << 16
SEGMENT, SEGMENTS = 16, 6
LONGEST = 64
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _pieces(run: bytes) -> list[bytes]:
    """The whole run in pieces of at most ``LONGEST`` bytes, cut between characters."""
    out, at = [], 0
    while len(run) - at > LONGEST:
        end = at + LONGEST
        while run[end] & 0xC0 == 0x80:
            end -= 1
        out.append(run[at:end])
        at = end
    return [*out, run[at:]]


def words(text: str) -> list[bytes]:
    """Lower-cased words that have a letter; a longer run without white space is successive words."""
    runs = text.lower().encode("utf-8", "surrogatepass").split()
    return [w for run in runs for w in ((run,) if len(run) <= LONGEST else _pieces(run)) if w.isalpha() or _ASCII_LETTER.search(w) or (not w.isascii() and _LETTER.search(w.decode("utf-8", "replace")))]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature numbers and the first position of each word's: 2- and 3-grams with word ends, affixes of three, the word."""
    bounded = [b"\x01" + w + b"\x02" for w in vocabulary]
    size = np.fromiter(map(len, bounded), np.int64, len(bounded))
    raw = np.frombuffer(b"".join(bounded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(bounded)), size)
    first = np.cumsum(size) - size
    found, owners = [], []

    def add(at: np.ndarray, k: int) -> None:
        h = np.full(len(at), np.uint64(k))
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + raw[at + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[at])

    left = np.repeat(first + size, size) - np.arange(len(raw))
    for k in (2, 3):
        add(np.flatnonzero(left >= k), k)
    long = np.flatnonzero(size >= 4)
    add(first[long], 4)
    add(first[long] + size[long] - 4, 4)
    found.append(np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in vocabulary), np.int64, len(vocabulary)))
    owners.append(np.arange(len(vocabulary)))
    flat, who = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return flat[order], np.searchsorted(who[order], np.arange(len(vocabulary)))


def posteriors(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over all sequences at once; emit: scores of all words, sequence by sequence.

    ``moves`` gets the expected number of each transition added."""
    n_seq, total = len(lengths), len(emit)
    p = np.exp(emit - emit.max(axis=1, keepdims=True)) if total else emit
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, length = start[order], lengths[order]
    active = n_seq - np.searchsorted(length[::-1], np.arange(int(length[0]) if n_seq else 0), side="right")
    step, ahead = np.exp(move - move.max()), np.empty_like(p)
    a = None
    for t, m in enumerate(active.tolist()):
        at = start[:m] + t
        a = (np.exp(begin - begin.max()) if t == 0 else a[:m] @ step) * p[at]
        a /= a.sum(axis=1, keepdims=True)
        ahead[at] = a
    out = np.empty_like(p)
    b = np.ones((n_seq, p.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        q = ahead[at] * b[:m]
        out[at] = q / q.sum(axis=1, keepdims=True)
        if moves is not None and t:
            pair = ahead[at - 1][:, :, None] * step * (p[at] * b[:m])[:, None, :]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        nb = (p[at] * b[:m]) @ step.T
        b[:m] = nb / nb.sum(axis=1, keepdims=True)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def emissions(self, vocabulary: list[bytes]) -> np.ndarray:
        if not vocabulary:
            return np.empty((0, len(self.languages)))
        flat, first = features(vocabulary)
        return np.add.reduceat(self.weights[flat], first, axis=0)


def train(passages: list[tuple[str, list[bytes]]], rounds: int = 6, seed: int = 5) -> Model:
    """passages: (language, words). Sequences splice passages of random languages; Adagrad on the CRF's likelihood."""
    languages = sorted({lang for lang, _ in passages})
    k = len(languages)
    if not k:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    vocabulary: dict[bytes, int] = {}
    coded = [(number[lang], np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in ws])) for lang, ws in passages if ws]
    flat, first = features(list(vocabulary))
    count = np.diff(np.append(first, len(flat)))
    model = Model(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    sums = {n: np.full_like(getattr(model, n), 1e-3) for n in ("weights", "move", "begin")}
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        order = r.permutation(len(coded))
        for i in range(0, len(order), 120):
            part = [coded[j] for j in order[i : i + 120]]
            seqs = [part[j : j + 4] for j in range(0, len(part), 4)]
            code = np.concatenate([c for s in seqs for _, c in s])
            gold = np.concatenate([np.full(len(c), y) for s in seqs for y, c in s])
            lengths = np.asarray([sum(len(c) for _, c in s) for s in seqs])
            used, back = np.unique(code, return_inverse=True)
            span = np.arange(int(count[used].sum())) + np.repeat(first[used] - (np.cumsum(count[used]) - count[used]), count[used])
            feats = flat[span]
            emit = np.add.reduceat(model.weights[feats], np.cumsum(count[used]) - count[used], axis=0)[back]
            move = np.zeros((k, k))
            q = posteriors(emit, lengths, model.move, model.begin, move)
            d = q.copy()
            d[np.arange(len(gold)), gold] -= 1
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, back, d)
            grad = np.zeros_like(model.weights)
            np.add.at(grad, feats, np.repeat(by_word, count[used], axis=0))
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths) - lengths] = False
            here = np.flatnonzero(inner)
            np.add.at(move, (gold[here - 1], gold[here]), -1)
            heads = np.cumsum(lengths) - lengths
            begin = d[heads].sum(axis=0)
            for name, g in (("weights", grad), ("move", move), ("begin", begin)):
                g = g / len(seqs)
                sums[name] += g * g
                setattr(model, name, getattr(model, name) - 0.3 * g / np.sqrt(sums[name]))
    model.weights = model.weights.astype(np.float32)
    return model


class Tagger:
    """Word probabilities of whole texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model, keep: int = 400_000):
        self.model, self.keep = model, keep
        self.reset()

    def reset(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.table = np.empty((0, len(self.model.languages)), np.float32)

    def tag(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if not self.model.languages:
            return [np.empty((len(ws), 0)) for ws in texts]
        if len(self.codes) > self.keep:
            self.reset()
        new, codes = [], []
        for ws in texts:
            own = []
            for w in ws:
                c = self.codes.get(w)
                if c is None:
                    c = self.codes[w] = len(self.codes)
                    new.append(w)
                own.append(c)
            codes.append(np.asarray(own, np.int64))
        for i in range(0, len(new), 50_000):
            self.table = np.concatenate([self.table, self.model.emissions(new[i : i + 50_000]).astype(np.float32)])
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        emit = self.table[np.concatenate(codes)] if len(codes) else self.table[:0]
        q = posteriors(emit.astype(np.float64), lengths, self.model.move, self.model.begin)
        return np.split(q, np.cumsum(lengths)[:-1])


def fit(docs: DataFrame, train_on: Column, lang: str = "lang", text: str = "text", per_language: int = 400, most_rows: int = 200_000) -> Model:
    """Train on the rows where ``train_on`` holds and ``lang`` isn't null: about ``per_language`` distinct texts of each language, with very many languages
    fewer of each, ``most_rows`` in all (that many languages at most, the commonest).

    Nothing but the text and ``lang`` decides what is learned: texts are drawn by their hash, so that neither ids nor files nor the order of rows matter.
    """
    good = docs.where(train_on & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    good = good.withColumn("at", F.xxhash64("text"))
    known = good.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()
    if not known:
        return train([])
    each = min(per_language, max(1, most_rows // len(known)))
    share = {r["lang"]: min(1.0, each / r["n"]) for r in known}
    part = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "text"), F.lit(1 << 30)) < part * float(1 << 30)
    rows = good.where(drawn).dropDuplicates(["lang", "at"])  # copies of a text are equal, so it doesn't matter which stays

    def passages(batches):
        for b in batches:
            out = []
            for lang, text, at in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "at")), strict=True):
                ws = words(text) if has_letter(text) else []
                for i in range(min(SEGMENTS, -(-len(ws) // SEGMENT))):
                    n = max(1, len(ws) - SEGMENT)
                    start = (at + i * n // SEGMENTS) % n
                    out.append((at, i, lang, [w.decode("utf-8", "replace") for w in ws[start : start + SEGMENT]]))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("at", "i", "lang", "words"), zip(*out, strict=True), strict=True)), schema=pa.schema([("at", pa.int64()), ("i", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string()))]))

    found = rows.mapInArrow(passages, "at long, i long, lang string, words array<string>").collect()
    return train([(r.lang, [w.encode() for w in r.words]) for r in sorted(found, key=lambda r: (r.at, r.i, r.lang, r.words))])


class _Shared:
    """A model on its way to the workers: about a megabyte of weights."""

    def __init__(self, docs: DataFrame, model: Model):
        self.name, self.sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)


def _tagged(batches, shared: _Shared):
    tagger = held(("tagger", shared.name), lambda: Tagger(shared.sent.value))
    for b in batches:
        at, size = 0, 0
        lengths = b.column("text").to_pylist()
        for i, t in enumerate(lengths):
            size += len(t or "")
            if size > 1_000_000 or i + 1 == len(lengths):
                texts = lengths[at : i + 1]
                ws = [words(t) if has_letter(t) else [] for t in texts]
                yield b.column("key").slice(at, i + 1 - at), ws, tagger.tag(ws)
                at, size = i + 1, 0


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    languages, shared = model.languages, _Shared(docs, model)

    def run(batches):
        for keys, ws, tags in _tagged(batches, shared):
            lang, score = [], []
            for w, q in zip(ws, tags, strict=True):
                mean = q.mean(axis=0) if len(w) and languages else None
                best = int(mean.argmax()) if mean is not None else -1
                lang.append(languages[best] if best >= 0 else "und")
                score.append(min(1.0, float(mean[best])) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_pydict({"key": keys, "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return _rows(docs, key, text).mapInArrow(run, "key long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the language of every word that has a letter, in order."""
    languages, shared = model.languages, _Shared(docs, model)

    def run(batches):
        for keys, ws, tags in _tagged(batches, shared):
            kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))
            got = [[{"word": w.decode("utf-8", "replace"), "lang": languages[i] if languages else "und"} for w, i in zip(own, q.argmax(axis=1) if q.size else [0] * len(own), strict=True)] for own, q in zip(ws, tags, strict=True)]
            yield pa.RecordBatch.from_pydict({"key": keys, "words": pa.array(got, kind)})

    return _rows(docs, key, text).mapInArrow(run, "key long, words array<struct<word:string,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose languages can't be told. All columns stay.

    Those are texts without a letter and texts whose words' best probabilities have a mean below ``least``, whichever
    languages these are of. Without a model only texts without a letter go."""
    languages, shared, schema, at = model.languages, _Shared(docs, model), docs.schema, docs.columns.index(text)

    def run(batches):
        for b in batches:
            rows = pa.RecordBatch.from_pydict({"key": pa.array(range(b.num_rows)), "text": b.column(at)})
            keep = np.zeros(b.num_rows, bool)
            for keys, ws, tags in _tagged([rows], shared):
                keep[keys.to_numpy()] = [len(w) > 0 and (not languages or float(q.max(axis=1).mean()) >= least) for w, q in zip(ws, tags, strict=True)]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
