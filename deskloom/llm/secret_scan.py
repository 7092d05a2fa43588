"""Secret scans: base patterns plus a small character convolutional network over every candidate in its context.

Candidates are runs of 6 or more key characters that hold a digit or a sign, mix cases, are 16 or longer, or stand right after a
colon, an equals sign or a quotation mark: everything but plain words in running text. The network sees windows over the whole
candidate with the characters before and after; a candidate's probability is the highest of its windows.

It is trained on every finding of all documents, those alike (value and windows) once: candidates on a base finding are positive,
the others unlabelled. Findings are dealt to shards of some thousands; in each round every shard takes steps over all of its own
from the same weights, and the next round starts from the mean of what they came to. As the base patterns find by telling words and fixed shapes, positives are shown mostly without those: in the
context of other candidates, and with their characters drawn anew from other alphabets and lengths. Unlabelled candidates count as
negative, but those that a first network takes for secrets are left out when the second is trained. A quarter of the findings, told
apart by their values, is held out: all of them calibrate the output to a probability, and the threshold is the highest, in steps of 1/1024
of the network's output, that keeps the wanted recall on held-out positives without their telling words. Spans that the network adds don't overlap base spans; base spans always stay.

Nulls: a null text is an empty one, without findings; ``redact`` keeps it null. A corpus without any base finding, or without any other
candidate, teaches nothing: then the base spans are all (``Network.p`` is empty). Repeated rows are scanned one by one.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .held import release

KINDS = ("assign", "access", "hex", "cnn")
# fixed values: the base patterns and the least length of what they find
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
TELLING = re.compile(r"[0-9+/_=]|[a-z][A-Z]|[A-Z]{2}[a-z]|[-.].|.{16}")
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
BEFORE, INSIDE, AFTER = 20, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
# a step's rows, a shard's least steps in a round; a shard's findings, of each class at least so many in the mean; parts of one in sums and in outputs; showings of a held positive
STEP, LEAST_STEPS, SHARD, LEAST, UNIT, BINS, SHOWINGS = 64, 64, 8192, 64, 2.0**36, 1024, 8
ALPHABETS = [np.frombuffer(a.encode(), np.uint8) for a in (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", LOWER + DIGITS, UPPER + DIGITS, "0123456789ABCDEF")]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; ends are exclusive, in code points."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in text.encode().translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates; stops, dashes and equals signs at the end of a run aren't part of it."""
    out = []
    for m in CANDIDATE.finditer(text):
        run, at = m[0].rstrip(".=-"), m.start()
        if len(run) >= 6 and (TELLING.search(run) or any(c in "\"':=" for c in text[max(0, at - 2) : at])):
            out.append((at, at + len(run)))
    return out


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Windows over the whole candidate, each with what stands before and after the candidate."""
    clean = lambda s: "".join(c if " " <= c <= "~" else "\x7f" for c in s).encode()
    before, after = clean(text[max(0, start - BEFORE) : start]).rjust(BEFORE, b"\0"), clean(text[end : end + AFTER]).ljust(AFTER, b"\0")
    return [before + clean(text[i : min(end, i + INSIDE)]).ljust(INSIDE, b"\0") + after for i in range(start, end, INSIDE)]


@dataclass
class Network:
    """Embedding, one convolution of width five, maxima over the three regions and a mean over the candidate, logistic."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0  # above every probability: adds nothing
    held_out: dict = field(default_factory=dict)

    EMBED, FILTERS, SPAN = 8, 16, 5

    @classmethod
    def start(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        e, f, w = cls.EMBED, cls.FILTERS, cls.SPAN
        return cls({"embed": r.normal(0, 0.5, (128, e)), "conv": r.normal(0, (2 / (w * e)) ** 0.5, (w * e, f)), "bias": np.zeros(f), "out": r.normal(0, 0.1, 4 * f), "base": np.zeros(1)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n = self.p, len(x)
        e = p["embed"][x] * (x > 0)[..., None]
        padded = np.pad(e, ((0, 0), (self.SPAN // 2, self.SPAN // 2), (0, 0)))
        cols = np.concatenate([padded[:, j : j + WIDTH] for j in range(self.SPAN)], axis=2)
        h = np.maximum(cols @ p["conv"] + p["bias"], 0)
        parts = [h[:, :BEFORE], h[:, BEFORE : BEFORE + INSIDE], h[:, BEFORE + INSIDE :]]
        tops = [q.argmax(axis=1) for q in parts]
        filled = (x[:, BEFORE : BEFORE + INSIDE] > 0)[..., None]
        count = np.maximum(filled.sum(axis=1), 1)
        mean = (parts[1] * filled).sum(axis=1) / count
        feats = np.concatenate([*(np.take_along_axis(q, t[:, None], 1)[:, 0] for q, t in zip(parts, tops, strict=True)), mean], axis=1)
        return feats @ p["out"] + p["base"][0], (n, x, cols, h, tops, filled, count, feats)

    def backward(self, cache: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        n, x, cols, h, tops, filled, count, feats = cache
        f, p = self.FILTERS, self.p
        g = {"out": feats.T @ d, "base": np.asarray([d.sum()])}
        df = d[:, None] * p["out"]
        dh = np.zeros_like(h)
        rows, cols_f = np.arange(n)[:, None], np.arange(f)[None]
        for i, (t, at) in enumerate(zip(tops, (0, BEFORE, BEFORE + INSIDE), strict=True)):
            np.add.at(dh, (rows, t + at, cols_f), df[:, i * f : (i + 1) * f])
        dh[:, BEFORE : BEFORE + INSIDE] += filled * (df[:, 3 * f :] / count)[:, None]
        dh *= h > 0
        g["conv"], g["bias"] = np.einsum("ntc,ntf->cf", cols, dh, optimize=True), dh.sum(axis=(0, 1))
        dc, e, half = dh @ p["conv"].T, self.EMBED, self.SPAN // 2
        de = np.zeros((n, WIDTH + 2 * half, e))
        for j in range(self.SPAN):
            de[:, j : j + WIDTH] += dc[:, :, j * e : (j + 1) * e]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x, de[:, half : half + WIDTH] * (x > 0)[..., None])
        return g

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -30, 30)))

    def train(self, good: np.ndarray, other: np.ndarray, rate: float, r: np.random.Generator) -> None:
        """Adam over all windows of both classes, half of each step from either; the fewer are taken anew until the others are through."""
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        half, steps = STEP // 2, max(LEAST_STEPS, math.ceil(2 * max(len(good), len(other)) / STEP))
        order = [np.concatenate([r.permutation(n) for _ in range(math.ceil(steps * half / n))]) for n in (len(other), len(good))]
        y = np.repeat(np.asarray([0, 1], np.float32), half)
        for step in range(1, steps + 1):
            at = slice((step - 1) * half, step * half)
            x = np.concatenate([other[order[0][at]], good[order[1][at]]])
            new, strange, blind = (y == 1) & (r.random(STEP) < 0.75), (y == 1) & (r.random(STEP) < 0.5), r.random(STEP) < 0.2
            x[new] = bare(x[new], other, r)
            x[strange] = relettered(x[strange], r)
            x[blind, :BEFORE] = 0
            x[blind, BEFORE + INSIDE :] = 0
            z, cache = self.forward(x)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / STEP
            for k, g in self.backward(cache, d).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, t: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt scaling by damped Newton steps, drawn to the identity, both classes weigh the same; and the threshold. n: how often z and t occur."""
        size = {y: n[t == y].sum() for y in (0, 1)}
        a, b, w = 1.0, 0.0, n * np.where(t == 1, 0.5 / max(1, size[1]), 0.5 / max(1, size[0])) * n.sum()
        loss = lambda a, b: (w * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum() + (a - 1) ** 2 / 2
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = w * q * (1 - q)
            g = np.asarray([(w * (q - t) * z).sum() + a - 1, (w * (q - t)).sum() + b])
            move, now = np.linalg.solve([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 1]], g), loss(a, b)
            while loss(a - move[0], b - move[1]) > now and abs(move).max() > 1e-9:
                move = move / 2
            a, b = np.asarray([a, b]) - move
        self.scale = (float(a), float(b))
        q, good = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), np.flatnonzero(t == 1)
        good = good[np.argsort(q[good])]
        self.threshold = float(q[good][np.searchsorted(np.cumsum(n[good]), int((1 - recall) * size[1]), "right")])
        hit = n * (q >= self.threshold)
        self.held_out = {"recall": float(hit[t == 1].sum() / size[1]), "false_alarms": float(hit[t == 0].sum() / size[0]), "positive": int(size[1]), "unlabelled": int(size[0])}


def bare(x: np.ndarray, others: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Windows with what stands around other candidates in place of their own surroundings."""
    x, y = x.copy(), others[r.integers(0, len(others), len(x))]
    x[:, :BEFORE], x[:, BEFORE + INSIDE :] = y[:, :BEFORE], y[:, BEFORE + INSIDE :]
    return x


def relettered(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Windows whose candidates have characters of another alphabet and another length, 12 at least."""
    x = x.copy()
    for row in x:
        k = int(r.integers(12, INSIDE + 1))
        row[BEFORE : BEFORE + INSIDE] = 0
        row[BEFORE : BEFORE + k] = r.choice(ALPHABETS[int(r.integers(len(ALPHABETS)))], k)
    return x


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _texts(batches):
    release()
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            yield b.column("key").slice(i, 1000), b.column("text").slice(i, 1000).to_pylist()


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, label, value, windows) of every candidate in all documents."""

    def run(batches):
        for key, texts in _texts(batches):
            out = []
            for k, t in zip(key.to_pylist(), texts, strict=True):
                if found := candidates(t):
                    base = base_spans(t)
                    out += [(k, s, int(any(s < e2 and s2 < e for s2, _, e2 in base)), t[s:e], windows(t, s, e)) for s, e in found]
            if out:
                k, s, y, v, w = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.int64()), "start": pa.array(s, pa.int64()), "label": pa.array(y, pa.int32()), "value": pa.array(v, pa.string()), "windows": pa.array(w, pa.list_(pa.binary()))})

    return _rows(docs, key, text).mapInArrow(run, "key long, start long, label int, value string, windows array<binary>")


FINDING = "shard long, h long, label int, learns boolean, holds boolean, windows array<binary>"


class Shard:
    """The findings of a shard in the order of their hashes, as windows."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("h", "ascending"), ("label", "ascending")])
        self.label, self.learns, self.holds = (np.asarray(rows.column(c).to_pylist()) for c in ("label", "learns", "holds"))
        self.windows = [as_rows(w) for w in rows.column("windows").to_pylist()]
        self.number = rows.column("shard")[0].as_py()

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty((0, WIDTH), np.int64), *(self.windows[i] for i in np.flatnonzero(rows))])


def as_rows(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH).astype(np.int64)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """label, held, h and windows of every finding in all documents; those of one value and the same windows are one."""
    return labelled(docs, key, text).select("label", (F.pmod(F.xxhash64("value"), F.lit(4)) == 0).alias("held"), F.xxhash64("value", "windows").alias("h"), "windows").distinct()


def dealt(found: DataFrame, n: dict[tuple[int, bool], int]) -> tuple[DataFrame, int]:
    """``FINDING`` by shards and their number. Each finding has one shard; those of a rare class learn in several, so that none is without. n: findings by label and held."""
    size = {y: n.get((y, False), 0) + n.get((y, True), 0) for y in (0, 1)}
    shards = math.ceil(sum(size.values()) / SHARD)
    by_label = lambda f: F.when(F.col("label") == 1, F.lit(f(1))).otherwise(F.lit(f(0)))
    few = by_label(lambda y: not (n.get((y, False)) and n.get((y, True))))  # too few to hold some out: all of them learn and are held
    copies = by_label(lambda y: min(shards, math.ceil(LEAST * shards / size[y])))
    rows = found.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")).select(
        F.pmod(F.pmod("h", F.lit(shards)) + F.col("copy"), F.lit(shards)).cast("long").alias("shard"), "h", "label", (~F.col("held") | few).alias("learns"),
        ((F.col("held") | few) & (F.col("copy") == 0)).alias("holds"), "windows",
    )
    return rows.repartition(4 * shards, "shard"), shards


def learner(net: Network, rate: float, seed: list[int]):
    """What a shard comes to in one round: a one for the shard itself, then all weights, as whole numbers."""

    def learn(rows):
        shard = Shard(rows)
        good, other = (shard.of(shard.learns & (shard.label == y)) for y in (1, 0))
        flat = np.empty(0)
        if len(good) and len(other):
            own = Network(dict(net.p))
            own.train(good, other, rate, np.random.default_rng([*seed, shard.number]))
            flat = np.concatenate([[1.0], *(a.ravel() for a in own.p.values())])
        return pa.table({"at": pa.array(np.arange(len(flat)), pa.int64()), "value": pa.array(np.rint(flat.astype(np.float64) * UNIT).astype(np.int64))})

    return learn


def trained(table: DataFrame, net: Network, rounds: int, seed: int) -> Network:
    """Rounds over all shards; weights are summed as whole numbers, so that the order of shards doesn't matter."""
    shapes = {k: a.shape for k, a in net.p.items()}
    ends = np.cumsum([math.prod(shape) for shape in shapes.values()])[:-1]
    for k in range(rounds):
        came = table.groupBy("shard").applyInArrow(learner(net, 0.005 * (1 - k / rounds), [seed, k]), "at long, value long")
        sums = {r["at"]: r["value"] for r in came.groupBy("at").agg(F.sum("value").alias("value")).collect()}
        if sums:
            mean = np.asarray([sums[i] / sums[0] for i in range(1, len(sums))])
            net = Network({name: a.reshape(shape) for (name, shape), a in zip(shapes.items(), np.split(mean, ends), strict=True)})
    return net


def without_sure(table: DataFrame, net: Network) -> DataFrame:
    """``table``, where unlabelled findings that the network takes for secrets learn no more."""

    def run(batches):
        for b in batches:
            learns = [a and (y == 1 or net.logits(as_rows(w)).max() <= 3) for a, y, w in zip(*(b.column(c).to_pylist() for c in ("learns", "label", "windows")), strict=True)]
            yield b.set_column(b.schema.get_field_index("learns"), "learns", pa.array(learns, pa.bool_()))

    return table.mapInArrow(run, FINDING)


def held_logits(table: DataFrame, net: Network, seed: int) -> DataFrame:
    """label, bin and n: how many held findings have which highest output; positives are shown ``SHOWINGS`` times, all in strange surroundings, half of other characters."""

    def run(rows):
        shard = Shard(rows)
        r, other = np.random.default_rng([seed, shard.number]), shard.of(shard.learns & (shard.label == 0))
        other = other if len(other) else shard.of(shard.label == 0)
        out = []
        for i in np.flatnonzero(shard.holds):
            x = shard.windows[i]
            shown = [x]
            if shard.label[i] == 1:
                shown = [bare(x, other, r) if len(other) else x for _ in range(SHOWINGS)]
                shown = [relettered(s, r) if j % 2 else s for j, s in enumerate(shown)]
            out += [(int(shard.label[i]), math.floor(BINS * float(np.clip(net.logits(s).max(), -30, 30)))) for s in shown]
        label, bins = zip(*out, strict=True) if out else ((), ())
        return pa.table({"label": pa.array(label, pa.int32()), "bin": pa.array(bins, pa.int32())})

    return table.groupBy("shard").applyInArrow(run, "label int, bin int").groupBy("label", "bin").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, recall: float = 0.98, rounds: int = 6, key: str = "doc_id", text: str = "text", seed: int = 3) -> Network:
    """Train, calibrate and set the threshold on every finding in all documents."""
    found = scratch.table(findings(docs, key, text), "findings")
    n = {(r.label, r.held): r["count"] for r in found.groupBy("label", "held").count().collect()}
    if len({y for y, _ in n}) < 2:
        scratch.drop(found)
        return Network()
    rows, shards = dealt(found, n)
    table = rows.persist()
    net = trained(table, Network.start(seed), rounds, seed)
    sifted = without_sure(table, net).repartition(4 * shards, "shard").persist()
    learning = lambda t: t.where("label = 0 AND learns").count()
    left = learning(sifted)
    if 0 < left < learning(table):
        net = trained(sifted, Network.start(seed), rounds, seed + 1)
    z = held_logits(sifted if left else table, net, seed).orderBy("label", "bin").collect()
    net.calibrate(np.asarray([r.bin / BINS for r in z]), np.asarray([float(r.label) for r in z]), np.asarray([r.n for r in z], float), recall)
    for used in (sifted, table):
        used.unpersist()
    scratch.drop(found)
    return net


def all_spans(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out, where, rows = [], [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, list(base)))
        if net.p:
            for s, e in candidates(t):
                if not any(s < e2 and s2 < e for s2, _, e2 in base):
                    w = windows(t, s, e)
                    rows += w
                    where += [(i, s, e)] * len(w)
    if rows:
        q = net.probability(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH).astype(np.int64))
        for i, s, e in sorted({w for w, hit in zip(where, q >= net.threshold, strict=True) if hit}):
            out[i][1].append((s, 3, e))
    return [(b, sorted(a)) for b, a in out]


def scan(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (array of kind, start, end) of every row, base spans marked by their kind."""

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for key, texts in _texts(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every] for _, every in all_spans(texts, net)]
            yield pa.RecordBatch.from_pydict({"key": key, "spans": pa.array(spans, pa.list_(kind))})

    return _rows(docs, key, text).mapInArrow(run, "key long, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs``, every column kept, with all spans masked in ``text``; ``length`` names a column of lengths to renew."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches):
        release()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                old = part.column(at).to_pylist()
                spans = all_spans([t or "" for t in old], net)
                new = [t if t is None or not a else masked(t, a) for t, (_, a) in zip(old, spans, strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(new, pa.string())
                if length:
                    j = part.schema.names.index(length)
                    cols[j] = pa.array([n if not a or t is None else len(t) for n, t, (_, a) in zip(cols[j].to_pylist(), new, spans, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, schema)
