"""Exact n-gram Jaccard join: documents by n-grams as a sparse matrix, multiplied in blocks.

Each document is the set of its distinct word n-grams (with fewer words, the whole sequence; without words, empty and
linked with nothing). Documents with equal sets are one node. Two nodes link when ``den * overlap >= num * union``, that is,
when their symmetric difference has at most ``(den - num) / (den + num)`` of the sum of their sizes.

Blocks. Sizes fall in bands, so that sets that link are in one band or in two that follow each other. A band sets the largest
difference H of two sets in it that link, and deals n-grams into H + s cells by hash. A difference of H n-grams spoils at most H cells,
so sets that link agree in s cells at least. The signature of a cell is the hash of all n-grams in it: unlike documents
with a passage in common hardly ever share one. A document with fewer than s signatures that others have too (empty cells
counted for it) has no link and is left out; so is a pair whose common signatures, added up over all of them, are too few. What is left connects documents into blocks. So no order of n-grams,
no sample and no limit decides what is found.

Products. Each block is multiplied with itself: rows are its documents, columns its n-grams. n-grams that most rows have
are taken off first: seen from this reference R a row is the small difference D(x) = x ^ R, and |x ^ y| = |D(x) ^ D(y)|.
With ``slack(x) = (den - num) n(x) - (den + num) |D(x)|``, rows link without any overlap of differences when their slacks
add up to 0 or more, so all such rows are connected through the row of largest slack. Only pairs with one of the other rows
remain, and they need ``-(slack(x) + slack(y)) / (2 (den + num))`` n-grams of their differences in common: overlap
counts are accumulated over the columns that two rows share, and pairs below that bound are dropped. Blocks of many rows
do the same as Spark joins: the reference by counts of n-grams, overlaps by a prefix of the differences, rare n-grams
first, keyed by n-gram and both sizes. A group of near copies that is less than half of such a block is far from its reference: it's connected
before, in parts of rows with the same least hash, and rows that are connected form no pair. No step forms all pairs of a group of near copies.

Links are turned into components by alternating minima over tables in the shared folder.

Sets, nodes and cells are told apart by 63- and 64-bit hashes; "exact" is up to their collisions. Nulls: a null text is empty;
a null key is never the id of a component unless no other key is in it. Equal keys are rows of their own. An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch
from .held import release

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text; A-Z lower-cased, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = mixed(out * M1 + h[j : n - k + 1 + j] * M2)
    return np.unique(out >> np.uint64(1))


def node_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


class Bound:
    """What sizes say about a link: den * overlap >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def difference(self, both):
        """The largest symmetric difference of two sets that link, given the sum of their sizes."""
        return both * (self.den - self.num) // (self.den + self.num)

    def slack(self, n, d):
        """Two sets link if their slacks add up to 0 at least, d being their differences from any one set."""
        return (self.den - self.num) * n - (self.den + self.num) * d

    def partner(self, n):
        """The largest set that can link with one of size n."""
        return n * self.den // self.num


class Bands:
    """First sizes of bands, each about half as large again as the one before; cells of each and how many of them must agree."""

    def __init__(self, bound: Bound, most: int = 1 << 40):
        self.bound, self.first, self.cells, self.agree = bound, [1], [], []
        steps = max(1, round(math.log(1.5) / math.log(bound.den / bound.num))) if bound.num < bound.den else 0
        while self.first[-1] < most:
            at = self.first[-1]
            for _ in range(steps):
                at = bound.partner(at)
            self.first.append(at + 1 if steps else most)
            apart = bound.difference(2 * (self.first[-1] - 1)) if steps else 0
            empty = (apart + 1) * math.exp(-self.first[-2] * bound.num / bound.den / (apart + 1))  # cells that a small set of the band leaves empty
            self.agree.append(1 + math.ceil(empty + 3 * math.sqrt(empty)))
            self.cells.append(apart and apart + self.agree[-1])  # without a difference to allow, equal sets are one node
        self.starts = np.asarray(self.first)

    def of(self, n: int) -> list[int]:
        band = int(np.searchsorted(self.starts, n, "right")) - 1
        return [x for x in ([band, band + 1] if self.bound.partner(n) >= self.first[band + 1] else [band]) if self.cells[x]]


def signatures(grams: np.ndarray, bands: Bands) -> list[tuple[int, int, np.ndarray]]:
    """(parity of the band, how many signatures a link needs, signatures) for each band of a set; the last bit of a signature is the parity."""
    out = []
    high, code = mixed(grams) >> np.uint64(32), mixed(grams ^ M2)
    for band in bands.of(len(grams)):
        k, agree = bands.cells[band], bands.agree[band]
        cell = (high * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(k, np.uint64)
        np.add.at(total, cell, code)
        held = np.zeros(k, bool)
        held[cell] = True
        at, none = np.flatnonzero(held), np.flatnonzero(~held)
        if len(none) >= agree:  # a link could lie in empty cells alone: it then shows in one of the first of them
            at = np.concatenate([at, none[: len(none) - agree + 1]])
        sig = mixed(total[at] + at.astype(np.uint64) * M1 + np.uint64((band + 1) * int(M2) % 2**64))
        out.append((band & 1, max(1, agree - len(none)), (sig >> np.uint64(1) << np.uint64(1) | np.uint64(band & 1)).view(np.int64)))
    return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))


def _each(batches):
    release()
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            yield b.slice(i, 1000), b.slice(i, 1000).column("text").to_pylist()


def _sets(rows: DataFrame, size: int, bands: Bands) -> DataFrame:
    """key, hash (of the text), n, node and, for bands of either parity, how many signatures a link needs (0: the set isn't in such a band)."""

    def run(batches):
        for rows, texts in _each(batches):
            n, node, need = [], [], np.zeros((2, len(texts)), np.int64)
            for i, t in enumerate(texts):
                g = ngrams(t, size)
                n.append(len(g))
                node.append(node_of(g))
                for parity, least, _ in signatures(g, bands) if len(g) else ():
                    need[parity, i] = least
            yield pa.RecordBatch.from_pydict({"key": rows.column("key"), "hash": rows.column("hash"), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "need_0": need[0], "need_1": need[1]})

    return rows.mapInArrow(run, "key long, hash long, n long, node long, need_0 long, need_1 long")


def _tile(sigs: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    """One row (sig, node, 0) of each signature of some documents, and (sig, node, node's own place) of all that two or more of them have.

    So a signature of very many documents sends one row of each tile to the task that looks for it elsewhere.
    """
    sig, node = np.concatenate(sigs), np.repeat(np.asarray(nodes, np.int64), [len(s) for s in sigs])
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(first)
    many = np.repeat(np.diff(np.append(start, len(sig))) > 1, np.diff(np.append(start, len(sig))))
    place = np.where(node[many] == 0, 1, node[many])
    return pa.RecordBatch.from_pydict({"sig": np.concatenate([sig[first], sig[many]]), "node": np.concatenate([node[first], node[many]]), "place": np.concatenate([np.zeros(len(start), np.int64), place])})


def _shared(rows: DataFrame, size: int, bands: Bands, tile: int = 500_000) -> DataFrame:
    """(sig, node) of signatures that two or more nodes have; rows may repeat."""

    def run(batches):
        sigs, nodes, held = [], [], 0
        for _, texts in _each(batches):
            for t in texts:
                g = ngrams(t, size)
                for _, _, s in signatures(g, bands) if len(g) else ():
                    sigs.append(s)
                    nodes.append(node_of(g))
                    held += len(s)
                if held >= tile:
                    yield _tile(sigs, nodes)
                    sigs, nodes, held = [], [], 0
        if held:
            yield _tile(sigs, nodes)

    together = Window.partitionBy("sig", "place")
    found = rows.mapInArrow(run, "sig long, node long, place long")
    found = found.withColumn("lo", F.min("node").over(together)).withColumn("hi", F.max("node").over(together))
    return found.where("place <> 0 OR lo < hi").select("sig", "node")


def _blocks(shared: DataFrame, nodes: DataFrame, pair_rows: int = 16) -> DataFrame:
    """(node, block) of all nodes that may have a link; a block holds all links of its nodes.

    Signatures that up to ``pair_rows`` nodes have are counted by pair: a pair stays if that count, and all signatures of more nodes
    that both may share, reach what either needs. A pair without any such signature shares enough of the others: then one lies
    in the prefixes of both, rarest first, that leave out one less than a link needs, and nodes star around the least one of each.
    """
    needs = nodes.select("node", F.posexplode(F.array("need_0", "need_1")).alias("parity", "need"))
    each = shared.groupBy("node", F.expr("CAST(sig & 1 AS int)").alias("parity")).agg(F.collect_set("sig").alias("sigs"))  # no more than a text has n-grams
    held = scratch.table(each.join(needs, ["node", "parity"]).where(F.size("sigs") >= F.col("need")).select("node", "parity", "need", "sigs"), "signed")
    cells = held.select("node", "parity", "need", F.explode("sigs").alias("sig"))
    sizes = cells.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    cells = scratch.table(cells.join(sizes, "sig"), "cells")
    wide = cells.where(F.col("c") > pair_rows).groupBy("node", "parity", "need").agg(F.sort_array(F.collect_list(F.struct("c", "sig"))).alias("wide"))
    wide = scratch.table(wide, "wide")
    about = held.select("node", "parity", "need").join(wide.select("node", "parity", F.size("wide").alias("n_wide")), ["node", "parity"], "left").fillna(0, ["n_wide"])
    one, two = (cells.where(F.col("c") <= pair_rows).select("sig", "parity", F.col("node").alias(x)) for x in ("a", "b"))
    met = one.join(two.drop("parity"), "sig").where("a < b").groupBy("a", "b", "parity").agg(F.count("*").alias("met"))
    for x in ("a", "b"):
        met = met.join(about.select(F.col("node").alias(x), "parity", F.col("need").alias(f"need_{x}"), F.col("n_wide").alias(f"wide_{x}")), [x, "parity"])
    near = met.where("met + least(wide_a, wide_b) >= greatest(need_a, need_b)").select(F.col("b").alias("u"), F.col("a").alias("v"))
    prefix = F.expr("transform(slice(wide, 1, cast(size(wide) - need + 1 AS int)), x -> x.sig)")
    stars = wide.where(F.size("wide") >= F.col("need")).select("node", F.explode(prefix).alias("sig"))
    least = stars.groupBy("sig").agg(F.min("node").alias("v"))
    stars = stars.join(least, "sig").where("node <> v").select(F.col("node").alias("u"), "v")
    # a node's partners, at most pair_rows of each signature, are tied to its least one: nodes of one group mostly have the same, so few edges are left
    tied = near.union(stars).groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("v")).select("u", "v", F.col("v")[0].alias("b"))
    edges = tied.select(F.col("u").alias("a"), "b").union(tied.select(F.explode(F.slice("v", F.lit(2), F.size("v"))), "b")).distinct()
    found = components(edges).toDF("node", "block")
    return scratch.table(found.union(found.select("block", "block").distinct()), "blocks", held, cells, wide)


def product(sets: list[np.ndarray], bound: Bound, most: int = 1_000_000) -> np.ndarray:
    """For each row of a block the least row that links lead to: the block's sparse product with itself.

    Rows are seen from the n-grams that most of them have. A tile of the rows that aren't connected by their slack is multiplied with all, over
    the columns that two rows have at least; what stays below the bound of a pair's sizes is dropped.
    """
    m = len(sets)
    n = np.fromiter(map(len, sets), np.int64, m)
    row = np.repeat(np.arange(m), n)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(2 * df > m)
    has = np.zeros((m, len(common)), bool)
    rank = np.full(len(df), -1)
    rank[common] = np.arange(len(common))
    inside = rank[col] >= 0
    has[row[inside], rank[col[inside]]] = True
    lacks, lacked = np.nonzero(~has)
    row, col = np.concatenate([row[~inside], lacks]), np.concatenate([col[~inside], common[lacked]])
    slack = bound.slack(n, np.bincount(row, minlength=m))
    best = int(np.argmax(slack))
    easy = slack + slack[best] >= 0
    a, b = [np.flatnonzero(easy)], [np.full(int(easy.sum()), best)]
    df = np.bincount(col, minlength=len(df))
    keep = df[col] > 1
    row, col = row[keep], col[keep]
    rows_of, first = row[np.argsort(col, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(col, minlength=len(df)))])
    order = np.argsort(row, kind="stable")
    col_of, start = col[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=m))])
    hard, at = np.flatnonzero(~easy), 0
    work = np.concatenate([[0], np.cumsum(np.bincount(row, weights=df[col], minlength=m)[hard])])
    while at < len(hard):
        to = max(at + 1, min(at + max(1, most // m), int(np.searchsorted(work, work[at] + most, "right")) - 1))
        counts = np.zeros((to - at) * m, np.int64)
        for i in range(at, to):
            c = col_of[start[hard[i]] : start[hard[i] + 1]]
            for part in np.array_split(c, max(1, int(df[c].sum()) // most)) if len(c) else ():
                size = df[part]
                places = np.repeat(first[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                counts[(i - at) * m : (i - at + 1) * m] += np.bincount(rows_of[places], minlength=m)
        counts = counts.reshape(to - at, m)
        good = 2 * (bound.den + bound.num) * counts + slack[hard[at:to], None] + slack[None] >= 0
        x, y = np.nonzero(good)
        a.append(hard[at:to][x])
        b.append(y)
        at = to
    a, b, least = np.concatenate(a), np.concatenate(b), np.arange(m)
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = least[least]
        if (least == before).all():
            return least


def _in_blocks(found: DataFrame, bound: Bound) -> DataFrame:
    """Links (a, b) within small blocks, as stars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        least = product([np.frombuffer(x, np.uint64) for x in pdf["grams"]], bound)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": node, "b": node[least]})[least != np.arange(len(node))]

    return found.select("block", "node", "grams").groupBy("block").applyInPandas(run, "a long, b long")


def _differences(found: DataFrame, bound: Bound) -> DataFrame:
    """block, node, n, base (mean size in the block), d, links, best and the n-grams in a row or the block's reference, not in both.

    links: the row links with the row of the largest slack, ``best``, whatever they have in common.
    """
    sizes = found.groupBy("block").agg(F.count("*").alias("rows"), F.avg("n").cast("long").alias("base"))

    def explode(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                g = [np.frombuffer(x, np.int64) for x in part.column("grams").to_pylist()]
                yield pa.RecordBatch.from_pydict({"block": np.repeat(part.column("block").to_numpy(), [len(x) for x in g]), "gram": np.concatenate(g)})

    counts = found.select("block", "grams").mapInArrow(explode, "block long, gram long").groupBy("block", "gram").agg(F.count("*").alias("c"))
    most = counts.join(sizes, "block").where("2 * c > rows").groupBy("block").agg(F.sort_array(F.collect_list("gram")).alias("most"))  # twice the mean set at most
    about = scratch.table(sizes.join(most, "block", "left"), "references")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                own = [np.frombuffer(x, np.uint64) for x in part.column("grams").to_pylist()]
                ref = [np.asarray(x or [], np.int64).view(np.uint64) for x in part.column("most").to_pylist()]
                diff = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(own, ref, strict=True)]
                n, d = (np.fromiter(map(len, x), np.int64, len(x)) for x in (own, diff))
                yield pa.RecordBatch.from_pydict({"block": part.column("block"), "node": part.column("node"), "n": n, "base": part.column("base"), "d": d, "slack": bound.slack(n, d), "diff": pa.array([x.tobytes() for x in diff], pa.binary())})

    seen = found.join(about, "block").mapInArrow(run, "block long, node long, n long, base long, d long, slack long, diff binary")
    seen = scratch.table(seen, "differences")
    best = seen.groupBy("block").agg(F.max(F.struct("slack", "node")).alias("best"))
    return seen.join(best, "block").select("block", "node", "n", "base", "d", (F.col("slack") + F.col("best.slack") >= 0).alias("links"), F.col("best.node").alias("best"), "diff")


def _connected(rows: DataFrame, bound: Bound, block_rows: int, block_cells: int, hashes: int = 3) -> DataFrame:
    """(node, root): rows of large blocks that links connect with a row of a lesser id, as far as parts of the blocks show it.

    A part holds a block's rows whose n-grams have the same least hash, for each of some hashes; near copies mostly do. Small parts are
    multiplied with themselves, in others rows link with the one of largest slack. So each group of near copies is connected, mostly, before pairs are formed.
    """

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                g = [np.frombuffer(x, np.uint64) for x in part.column("grams").to_pylist()]
                block = part.column("block").to_numpy().view(np.uint64)
                for k in range(1, hashes + 1):
                    least = np.fromiter((mixed(x ^ np.uint64(k * int(M1) % 2**64)).min() for x in g), np.uint64, len(g))
                    at = mixed(mixed(block + np.uint64(k)) * M1 + least).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"block": at, "node": part.column("node"), "n": part.column("n"), "grams": part.column("grams")})

    parts = scratch.table(rows.select("block", "node", "n", "grams").mapInArrow(run, "block long, node long, n long, grams binary"), "parts")
    sizes = parts.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("cells")).where("rows > 1")
    parts = parts.join(sizes.select("block", ((F.col("rows") <= block_rows) & (F.col("cells") <= block_cells)).alias("small")), "block")
    seen = _differences(parts.where("NOT small"), bound)
    near = _in_blocks(parts.where("small"), bound).unionByName(seen.where("links AND node <> best").select(F.col("node").alias("a"), F.col("best").alias("b")))
    return components(near)


def _by_difference(seen: DataFrame, connected: DataFrame, bound: Bound, steps: int = 8) -> DataFrame:
    """Links between rows of large blocks: by the rare n-grams of their differences, for each pair of sizes.

    Rows that are connected already form no pair: those that link with the best row, and those of one root in ``connected``. Of a row's links with
    such a part one is given.
    """
    part = F.when(F.col("links"), F.col("best")).otherwise(F.coalesce("root", "node"))
    seen = seen.join(connected, "node", "left").withColumn("part", part).drop("root", "best")
    to_array = lambda batches: (
        pa.RecordBatch.from_pydict({"block": b.column("block"), "node": b.column("node"), "gram": pa.array([np.frombuffer(x, np.int64) for x in b.column("diff").to_pylist()], pa.list_(pa.int64()))}) for b in batches
    )
    cells = seen.select("block", "node", "diff").mapInArrow(to_array, "block long, node long, gram array<long>").select("block", "node", F.explode("gram").alias("gram"))
    often = cells.groupBy("block", "gram").agg(F.count("*").alias("c")).where("c > 1")
    rare_first = F.transform(F.sort_array(F.collect_list(F.struct("c", "gram"))), lambda x: x["gram"])
    ordered = cells.join(often, ["block", "gram"]).groupBy("block", "node").agg(rare_first.alias("grams"))
    ordered = ordered.join(seen.select("block", "node", "n", "base", "d", "links", "part"), ["block", "node"])

    def keys(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            most = bound.difference(r.n + bound.partner(r.n))  # no partner's bound is larger
            w = max(1, bound.difference(2 * r.base) // steps)  # sizes of differences go in classes of a width that the block's mean size sets
            own, alone = r.d // w, r.d - len(r.grams)  # n-grams that no other member has come first
            for other in range(max(0, (r.d - most) // w), (r.d + most) // w + 1):
                need = max(1, -((most - r.d - max(1, other * w)) // 2))
                take = max(0, r.d - need + 1 - alone)
                lo, hi = min(own, other), max(own, other)
                out += [(r.block, g, lo, hi, own, r.node, r.links, r.part) for g in r.grams[:take].tolist()]
        return pd.DataFrame(out, columns=["block", "gram", "lo", "hi", "own", "node", "links", "part"])

    keyed = ordered.mapInPandas(lambda parts: (keys(p) for p in parts), "block long, gram long, lo long, hi long, own long, node long, links boolean, part long")
    on = ["block", "gram", "lo", "hi"]
    left = keyed.where("NOT links").select(*on, F.col("node").alias("a"), F.col("own").alias("own_a"), F.col("part").alias("part_a"))
    right = keyed.select(*on, F.col("node").alias("b"), F.col("own").alias("own_b"), F.col("links").alias("links_b"), F.col("part").alias("part_b"))
    met = left.join(right, on).where("part_a <> part_b AND own_a + own_b = lo + hi AND (links_b OR a < b)").select("block", "a", "b", "part_b").distinct()
    one, two = (seen.select("block", F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("diff").alias(f"d_{k}")) for k in ("a", "b"))

    def check(batches):
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(c).to_pylist()] for c in ("d_a", "d_b"))
            apart = np.fromiter((len(np.setxor1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)), np.int64, len(x))
            good = apart <= bound.difference(b.column("n_a").to_numpy() + b.column("n_b").to_numpy())
            yield b.select(["a", "b", "part_b"]).filter(pa.array(good))

    good = met.join(one, ["block", "a"]).join(two, ["block", "b"]).mapInArrow(check, "a long, b long, part_b long")
    return good.groupBy("a", "part_b").agg(F.min("b").alias("b")).select("a", "b")


def _fetched(rows: DataFrame, asked: DataFrame, size: int, most_bits: int = 26) -> DataFrame:
    """asked with the n-grams of its nodes, from the texts.

    Texts aren't shuffled: a map of hashed keys, of at most 2^26 bits (8 MB, in rows of 4 KB), goes to every task, which makes the
    sets of the keys that are in it; the join then drops what only shares a bit with an asked key.
    """
    bits = min(most_bits, max(15, (16 * asked.count()).bit_length()))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    maps = asked.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    filled = np.zeros((1 << bits - 15, 4096), np.uint8)
    for r in maps.collect():  # 2^(bits - 15) rows at most
        filled[r.row - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    known = rows.sparkSession.sparkContext.broadcast(filled.reshape(-1))

    def build(batches):
        for b in batches:
            at = b.column("place").to_numpy()
            b = b.filter(pa.array(known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            for i in range(0, b.num_rows, 500):
                g = [ngrams(t, size) for t in b.column("text").slice(i, 500).to_pylist()]
                yield pa.RecordBatch.from_pydict({"own": b.column("key").slice(i, 500), "made": pa.array(map(node_of, g), pa.int64()), "grams": pa.array([x.tobytes() for x in g], pa.binary())})

    sets = rows.select("key", "text", place.alias("place")).mapInArrow(build, "own long, made long, grams binary")
    return sets.join(asked, (F.col("made") == F.col("node")) & F.col("own").eqNullSafe(F.col("key"))).drop("own", "made", "key")  # a key may have several texts


def links(nodes: DataFrame, rows: DataFrame, size: int, bands: Bands, block_rows: int = 2048, block_cells: int = 2_000_000) -> DataFrame:
    """(a, b): links that connect all nodes that any links connect."""
    bound = bands.bound
    shared = scratch.table(_shared(rows, size, bands), "shared")
    asked = nodes.select("node", "key", "n").join(_blocks(shared, nodes), "node")
    sizes = asked.groupBy("block").agg(((F.count("*") <= block_rows) & (F.sum("n") <= block_cells)).alias("small"))
    asked = scratch.table(asked.join(sizes, "block"), "asked", shared)
    found = scratch.table(_fetched(rows, asked, size), "sets")
    near = _in_blocks(found.where("small"), bound)
    if asked.where("NOT small").isEmpty():
        return scratch.table(near, "links", asked, found)
    seen = _differences(found.where("NOT small"), bound)
    near = near.unionByName(seen.where("links AND node <> best").select(F.col("node").alias("a"), F.col("best").alias("b")))
    seen = seen.join(seen.where("NOT links").select("block").distinct(), "block", "left_semi")  # elsewhere all is connected
    hard = found.where("NOT small").join(seen.where("NOT links").select("block", "node").distinct(), ["block", "node"], "left_semi")
    connected = _connected(hard, bound, block_rows, block_cells)
    near = near.unionByName(connected.toDF("a", "b")).unionByName(_by_difference(seen, connected, bound))
    return scratch.table(near, "links", asked, found)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that isn't a root itself: roots are the least ids; large and small stars in turn.

    Least neighbours are tables of their own, so that both sides of each join are plain exchanges and Spark can split a node
    with very many neighbours.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u <> v").distinct(), "large_stars", now, low)
        down = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = scratch.table(small.where("u <> v").distinct(), "stars", large, down)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.toDF("node", "root")


def join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", block_rows: int = 2048) -> DataFrame:
    """key, n (set size), component (the least key that links lead to), root (one for each component) and hash (of the text) of every row."""
    bands = Bands(Bound(num, den))
    rows = _rows(docs, key, text)
    sets = scratch.table(_sets(rows, size, bands), "set_sizes")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "n", "need_0", "need_1")).alias("f")
    nodes = scratch.table(sets.where("n > 0").groupBy("node").agg(first).select("node", "f.key", "f.n", "f.need_0", "f.need_1"), "nodes")
    found = components(links(nodes, rows, size, bands, block_rows))
    least = nodes.select("node", "key").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = least.groupBy("root").agg(F.min("key").alias("component"))
    of = least.join(ids, "root").select("node", "root", "component")
    return sets.join(of, "node", "left").select("key", "n", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component")).alias("component"), "root", "hash")
