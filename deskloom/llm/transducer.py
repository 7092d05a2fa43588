"""BPE through a minimal acyclic transducer lexicon.

Words are counted over the whole corpus; the most frequent ones are compiled, with their ids, into a minimal
acyclic automaton (equal suffixes share states). Counts of words below each arc turn a path into the word's
ordinal, and the ordinal finds the ids. The automaton is one file in the shared folder, which workers memory-map;
whole arrays of words walk it together. A word outside the lexicon is merged exactly, by rank, leftmost first.

The tokenizer file must hold a lower-casing BPE with word ends: NFC, white space dropped, words split by the
file's own pattern, bytes as printable characters. Its added tokens keep their ids wherever a text has their strings.

Nulls: a null text is an empty one: no ids, an empty decoding. An empty table gives no row. Repeated rows and
keys stay as they are; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import re
import shutil
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .chunk_bpe import _ODD, SPACE
from .held import held

_RUN = re.compile(f"[^{SPACE}]+")
NONE = np.int64(1 << 40)


def runs(text: str) -> list[str]:
    """Runs of characters that aren't white space."""
    return _RUN.findall(text) if _ODD.search(text) else text.split()


def byte_chars() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merges:
    """The vocabulary and merge ranks of a tokenizer file, and exact merging."""

    def __init__(self, path: str):
        self.path, self.tok = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in (vocab | self.added).items():
            self.tokens[i] = t
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        char = byte_chars()
        self.inner = np.asarray([vocab[c] for c in char], np.int64)
        self.last = np.asarray([vocab[c + end] for c in char], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.asarray([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.asarray([vocab[a + b] for a, b in pairs], np.int64)
        self.by_key = None

    def rank(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def split(self, run: str) -> list[str | int]:
        """Words of a run, normalised, and ids of added tokens."""
        if "<|" in run and self.special.search(run):
            parts = [x for x in self.special.split(run) if x]
            return [w for x in parts for w in ([self.added[x]] if x in self.added else self.split(x))]
        if not run.isascii():
            if max(run) > "\u0557" and any(unicodedata.category(c) == "Cn" for c in run):
                return self.split_by_library(run)
            run = unicodedata.normalize("NFC", run).replace("Σ", "σ")
        elif run.isalpha():
            return [run.lower()]
        return self.words.findall(run.lower())

    def split_by_library(self, run: str) -> list[str]:
        """For characters that Python's Unicode tables don't have, and the library's may: its own normaliser and pattern."""
        if self.tok is None:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(self.path)
            self.byte = {c: i for i, c in enumerate(byte_chars())}
        parts = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(run))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in parts]

    def long(self, word: bytes) -> list[int]:
        """One word by a heap of pairs, for words of any length."""
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        right, left, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (r := self.by_key.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word; every round merges the lowest-ranked, leftmost pair of every word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        done: dict[int, np.ndarray] = {int(i): np.asarray(self.long(words[i]), np.int64) for i in np.flatnonzero(size > 48)}
        live = np.flatnonzero((size <= 48) & (size > 0))
        raw = np.frombuffer(b"".join(words[i] for i in live.tolist()), np.uint8)
        ids, word = self.inner[raw], np.repeat(live, size[live])
        ends = np.cumsum(size[live]) - 1
        ids[ends] = self.last[raw[ends]]
        kept_ids, kept_word = [], []
        while len(ids):
            pair = np.full(len(ids), NONE)
            same = word[1:] == word[:-1]
            pair[:-1][same] = self.rank((ids[:-1] << 20 | ids[1:])[same])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            low = np.minimum.reduceat(pair, first)
            length = np.diff(np.append(first, len(ids)))
            open_ = np.repeat(low < NONE, length)
            kept_ids.append(ids[~open_])
            kept_word.append(word[~open_])
            if not open_.any():
                break
            hits = np.flatnonzero((pair == np.repeat(low, length)) & open_)
            hits = hits[np.unique(word[hits], return_index=True)[1]]
            ids[hits] = self.made[pair[hits]]
            open_[hits + 1] = False
            ids, word = ids[open_], word[open_]
        for i, x in done.items():
            kept_ids.append(x)
            kept_word.append(np.full(len(x), i))
        flat, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (kept_ids, kept_word))
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words)).astype(np.int64)


def compile_lexicon(words: list[bytes], flat: np.ndarray, count: np.ndarray) -> bytes:
    """The file of a minimal acyclic transducer: sorted arcs (state, byte) with target and ordinal offset; ids by ordinal."""
    order = sorted(range(len(words)), key=words.__getitem__)
    starts = np.concatenate([[0], np.cumsum(count)])
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # final, arcs as [byte, state]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            sign = (final, tuple(arcs))
            if sign not in register:
                register[sign] = len(states)
                states.append(sign)
            path[-1][1][-1] = (path[-1][1][-1][0], register[sign])

    before = b""
    for i in order:
        w = words[i]
        same = len(os.path.commonprefix([before, w]))
        close(same)
        for b in w[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        before = w
    close(0)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(states), np.int64)  # words that end at or below a state; targets come before sources
    key, to, skip = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for b, t in arcs:
            key.append(s << 8 | b)
            to.append(t)
            skip.append(n)
            n += int(below[t])
        below[s] = n
    ids = np.concatenate([flat[starts[i] : starts[i + 1]] for i in order]) if order else np.empty(0)
    ends = np.concatenate([[0], np.cumsum(count[order])]) if order else np.zeros(1)
    parts = [np.asarray(key, "<i8"), np.asarray(to, "<i8"), np.asarray(skip, "<i8"), np.asarray([f for f, _ in states], "<i8"), ends.astype("<i8"), ids.astype("<i8")]
    head = np.asarray([root, *map(len, parts)], "<i8")
    out = io.BytesIO()
    for x in (head, *parts):
        out.write(x.tobytes())
    return out.getvalue()


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path):
        raw = np.memmap(path, "<i8", "r")
        self.root, at, parts = int(raw[0]), 7, []
        for n in raw[1:7].tolist():
            parts.append(raw[at : at + n])
            at += n
        self.key, self.to, self.skip, self.final, self.ends, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 for words outside."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        live = np.flatnonzero(size)
        state, ordinal, step = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state << 8 | raw[first[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            good = self.key[at] == key
            live, at = live[good], at[good]
            state, ordinal = self.to[at], ordinal[good] + self.skip[at]
            step += 1
            over = size[live] == step
            ended = over & (self.final[state] == 1)
            out[live[ended]] = ordinal[ended]
            live, state, ordinal = live[~over], state[~over], ordinal[~over]
        return out


def mapped(uri: str):
    """A file in the shared folder to be memory-mapped; where that folder isn't a mounted one, a nameless copy that goes with its map."""
    if uri.startswith("file:"):
        return re.sub("^file:/*", "/", uri)
    store, name = fs.FileSystem.from_uri(uri)
    own = tempfile.TemporaryFile()
    with store.open_input_stream(name) as f:
        shutil.copyfileobj(f, own)
    own.flush()
    return own


class Encoder:
    """Ids of whole texts; remembers a bounded number of runs and of merged words."""

    def __init__(self, vocabulary: str, lexicon: str, keep: int = 400_000):
        self.merges, self.lexicon, self.keep = Merges(vocabulary), Lexicon(mapped(lexicon)), keep
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word: by the transducer, by merging where that has no path."""
        at = self.lexicon.find(words)
        known = at >= 0
        flat, n = self.merges.merge([words[i] for i in np.flatnonzero(~known).tolist()])
        count, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[known], first[known] = self.lexicon.ends[at[known] + 1] - self.lexicon.ends[at[known]], self.lexicon.ends[at[known]]
        count[~known], first[~known] = n, len(self.lexicon.ids) + np.cumsum(n) - n
        both = np.concatenate([self.lexicon.ids, flat])
        return both[spans(first, count)], count

    def learn(self, new: list[str]) -> None:
        number: dict[bytes, int] = {}
        parts, owner = [], []
        for k, run in enumerate(new):
            for w in self.merges.split(run):
                parts.append(-1 - w if isinstance(w, int) else number.setdefault(w.encode(), len(number)))
                owner.append(k)
        flat, n = self.words(list(number))
        code = np.asarray(parts, np.int64)
        added = code < 0
        start = np.cumsum(n) - n
        if len(n):
            count, first = np.where(added, 1, n[np.maximum(code, 0)]), np.where(added, len(flat) - 1 - code, start[np.maximum(code, 0)])
        else:
            count, first = np.ones(len(code), np.int64), len(flat) - 1 - code
        ids = np.concatenate([flat, np.arange(len(self.merges.tokens))])[spans(first, count)]
        per = np.bincount(np.asarray(owner, np.int64), weights=count, minlength=len(new)).astype(np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(per) - per])
        self.count = np.concatenate([self.count, per])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > self.keep:
            self.reset()
        new, codes = [], []
        get = self.codes.get
        for t in texts:
            own = runs(t)
            c = [get(r, -1) for r in own]
            if -1 in c:
                for i, (r, k) in enumerate(zip(own, c, strict=True)):
                    if k < 0:
                        if (k := get(r)) is None:
                            k = self.codes[r] = len(self.codes)
                            new.append(r)
                        c[i] = k
            codes.append(np.asarray(c, np.int64))
        if new:
            self.learn(new)
        return [self.flat[spans(self.first[c], self.count[c])] for c in codes]


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All indices first, first+1, ..., of every span, in order."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(first - (ends - count), count)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def frequent_words(docs: DataFrame, vocabulary: str, words: int, text: str = "text") -> list[bytes]:
    """The most frequent normalised words of all texts, seen twice or more; at most ``words`` reach the driver.

    The words counted are a table; the lowest level of counts from which all words fit is found first, so that no task sends words that aren't wanted.
    """

    def count(batches):
        m = Merges(vocabulary)
        seen: Counter = Counter()

        def flush():
            found: Counter = Counter()
            for run, n in seen.items():
                for w in m.split(run):
                    if not isinstance(w, int) and len(w) <= 48:
                        found[w] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(runs(t))
                if len(seen) > 400_000:
                    yield flush()
        if seen:
            yield flush()

    rows = _texts(docs.withColumn("__k", F.lit(0)), "__k", text).select("text").mapInArrow(count, "word string, n long")
    counts = scratch.table(rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word_counts")
    level = F.floor(F.log2("n") * 16)
    floor, fits = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        fits += r["count"]
        if fits > words:
            break
        floor = r["level"]
    found = [] if floor is None else counts.where(level >= floor).select("n", "word").collect()
    scratch.drop(counts)
    return [w.encode() for _, w in sorted(((r.n, r.word) for r in found), key=lambda x: (-x[0], x[1]))]


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = 60_000, text: str = "text") -> str:
    """Compile the corpus's frequent words to a file in the shared folder; returns its URI."""
    found = [w for w in frequent_words(docs, vocabulary, words, text) if w]
    blob = compile_lexicon(found, *Merges(vocabulary).merge(found))
    uri = scratch.folder(docs.sparkSession, "lexicon")
    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(name, recursive=True)
    with store.open_output_stream(f"{name}/words.bin") as f:
        f.write(blob)
    return f"{uri}/words.bin"


def encode(docs: DataFrame, vocabulary: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every row."""
    return _texts(docs, key, text).mapInArrow(lambda batches: _encoded(batches, vocabulary, lexicon), "key long, ids array<int>")


def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    return held(("transducer", vocabulary, lexicon), lambda: Encoder(vocabulary, lexicon))


def _slices(batches, step: int = 300):
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.column("key").slice(i, step), b.column("text").slice(i, step).to_pylist()


def _encoded(batches, vocabulary, lexicon):
    enc = _encoder(vocabulary, lexicon)
    for key, texts in _slices(batches):
        yield pa.RecordBatch.from_pydict({"key": key, "ids": pa.array(enc.encode(texts), pa.list_(pa.int32()))})


def decode(tokens: list[str], ids: list[int]) -> str:
    """A file without a decoder of its own: tokens joined by a space."""
    return " ".join(map(tokens.__getitem__, ids))


def digests(docs: DataFrame, vocabulary: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and hashes of the joined ids and of the decoded text; ids and decodings stay in their task."""

    def run(batches):
        enc = _encoder(vocabulary, lexicon)
        tokens = enc.merges.tokens
        number = [str(i) for i in range(len(tokens))]
        for key, texts in _slices(batches):
            n, a, b = [], [], []
            for x in enc.encode(texts):
                ids = x.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(decode(tokens, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"key": key, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b})

    return _texts(docs, key, text).mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
