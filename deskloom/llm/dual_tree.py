"""Hard negatives by dual-tree search: a tree over the anchors against a tree over all rows, pruned by inner-product intervals of node pairs.

Vectors become integers, so that scores are exact. A coarse tree of at most ``MOST_LEAVES`` leaves, fitted to at most ``SAMPLE`` rows, deals every
row to a leaf; leaves are cut into parts of bounded size, and each part's rows lie in the order of a balanced tree of their own. Anchors are
packed likewise, as blocks that are nodes of a tree over them. A node is a ball; of two balls with centres a, c and radii r, s the inner products lie
within <a, c> +- (r |c| + s |a| + r s). A block goes to the leaves whose interval meets what it still looks for, meets the parts there as they
stream by, and descends both trees at once; only pairs of their leaves that no interval rules out are scored, exactly.

What a block looks for are slots: an anchor, a range of scores, same or other label, and how many rows. A first visit to the
block's own leaf raises the lower ends, so that the full visit prunes by them. Slots of positives come first, slots of negatives follow from their scores.

Rows: those with a null label or vector, or with a null, non-finite or too large entry (``LARGEST``), take no part, nor do vectors of another length
than most have. Rows with one key are rows of their own: each is an anchor if its key says so, and may be another's positive. A null
key is no anchor and comes last among ties, as does 2^63 - 1, which is given back as null. Without anchors or positives the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch, vectors

SAMPLE, MOST_LEAVES, PART_ROWS, BLOCK = 20_000, 1024, 32_768, 128
FINE, FINE_ANCHORS, AT_ONCE = 128, 16, 8  # rows of a tree leaf, anchors of one, leaves scored together
LARGEST = float(1 << 14)  # with it scores of up to 2^19 dimensions stay below 2^63
KINDS = {b"2": np.int16, b"4": np.int32}
NO_KEY, LOW, HIGH = (1 << 63) - 1, -(1 << 62), 1 << 62

ROW = "leaf int, part int, kind int, block long, ids array<long>, rows array<long>, labels array<long>, data binary, slots array<long>, owner array<int>, lo array<long>, hi array<long>"


class Coarse:
    """Splits of a bounded sample at medians of its widest dimensions; a leaf's centre is the mean of the sample there."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.at = np.zeros(leaves - 1, int), np.zeros(leaves - 1)
        held = [sample]
        for node in range(leaves - 1):
            own = held[node]
            if len(own):
                self.dim[node] = int(own.var(axis=0).argmax())
                self.at[node] = np.median(own[:, self.dim[node]])
            right = own[:, self.dim[node]] > self.at[node]
            held += [own[~right], own[right]]
        nothing = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        self.centres = np.array([h.mean(axis=0) if len(h) else nothing for h in held[leaves - 1 :]])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while len(self.dim) and node.max(initial=0) < len(self.dim):
            inner = node < len(self.dim)  # all leaves lie on one level
            node = np.where(inner, 2 * node + 1 + (x[np.arange(len(x)), self.dim[node * inner]] > self.at[node * inner]), node)
        return node - len(self.dim)


def _edges(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end, halved until none has more than ``leaf`` rows; node i has children 2i and 2i + 1."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        e = levels[-1]
        levels.append(np.sort(np.concatenate([e, (e[:-1] + e[1:]) // 2])))
    return levels


def arranged(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order in which every node of ``_edges`` holds rows on one side of its parent's median, in the widest dimension."""
    order = np.arange(len(x))
    for e in _edges(len(x), leaf)[:-1]:
        for s, t in zip(e[:-1], e[1:], strict=True):
            own = x[order[s:t]]
            values = own[:, own.var(axis=0).argmax()]
            order[s:t] = order[s:t][np.argpartition(values, (s + t) // 2 - s)]
    return order


class Tree:
    """Rows in ``arranged`` order with the balls of all nodes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, data: bytes, leaf: int):
        n = len(rows)
        self.ids, self.rows, self.labels = ids, rows, labels
        self.x = np.frombuffer(data, KINDS[data[:1]], offset=1).reshape(n, -1).astype(np.float64)
        self.most = float(np.sqrt((self.x**2).sum(axis=1).max(initial=0)))
        self.edges = _edges(n, leaf)
        self.centres, self.radii, self.sizes = [], [], []
        for e in self.edges:
            counts = np.diff(e)
            c = np.add.reduceat(self.x, e[:-1], axis=0) / counts[:, None]
            away = np.sqrt(((self.x - np.repeat(c, counts, axis=0)) ** 2).sum(axis=1))
            self.centres.append(c)
            self.radii.append(np.maximum.reduceat(away, e[:-1]) * (1 + 1e-9))
            self.sizes.append(np.sqrt((c**2).sum(axis=1)))


def _bytes(x: np.ndarray) -> bytes:
    """The numbers after a mark of their width, 16 bits where they suffice."""
    narrow = x.astype(np.int16)
    return b"2" + narrow.tobytes() if np.array_equal(narrow, x) else b"4" + x.astype(np.int32).tobytes()


def scores(a: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers held as floats; ``most`` bounds them, and with them all partial sums."""
    if most < 1 << 24:
        return (a.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ c.T).astype(np.int64)
    return a.astype(np.int64) @ c.astype(np.int64).T


def interval(a: np.ndarray, r: np.ndarray, a_size: np.ndarray, c: np.ndarray, s: np.ndarray, c_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any two points of balls of paired rows, with room for rounding."""
    middle = (a * c).sum(axis=-1)
    wide = r * c_size + s * a_size + r * s
    wide = wide + 0.5 + 1e-9 * (np.abs(middle) + wide)
    return middle - wide, middle + wide


class Slots:
    """What the anchors of a block look for, and the best rows each slot has met: score, then key."""

    def __init__(self, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, keep: int, same: bool):
        self.owner, self.lo, self.hi, self.keep, self.same = owner, lo.copy(), hi, keep, same
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def needs(self, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of anchors the least score and the greatest that one of its slots can use."""
        lo, hi = np.full(n, HIGH), np.full(n, LOW)
        np.minimum.at(lo, self.owner, self.lo)
        np.maximum.at(hi, self.owner, self.hi)
        return np.minimum.reduceat(lo, edges[:-1]), np.maximum.reduceat(hi, edges[:-1])

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        slot, score, key = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, key)))
        order = np.lexsort((key, -score, slot))
        slot, score, key = slot[order], score[order], key[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        kept = rank < self.keep
        self.slot, self.score, self.id = slot[kept], score[kept], key[kept]
        last = rank == self.keep - 1
        self.lo[slot[last]] = np.maximum(self.lo[slot[last]], score[last])  # an equal score may still come first by its key


def _leaf_pairs(anchors: Tree, part: Tree, slots: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves that no interval on the way down rules out, and the greatest product each may hold."""
    i = j = np.zeros(1, int)
    la, lc, last_a, last_c = 0, 0, len(anchors.edges) - 1, len(part.edges) - 1
    while True:
        lo, hi = slots.needs(anchors.edges[la], len(anchors.rows))
        least, most = interval(
            anchors.centres[la][i], anchors.radii[la][i], anchors.sizes[la][i], part.centres[lc][j], part.radii[lc][j], part.sizes[lc][j]
        )
        open_ = (most >= lo[i]) & (least <= hi[i])
        i, j, most = i[open_], j[open_], most[open_]
        if la == last_a and lc == last_c:
            return i, j, most
        if lc < last_c:
            i, j, lc = np.repeat(i, 2), np.stack([2 * j, 2 * j + 1], axis=1).ravel(), lc + 1
        if la < last_a:
            i, j, la = np.stack([2 * i, 2 * i + 1], axis=1).ravel(), np.repeat(j, 2), la + 1


def search(anchors: Tree, part: Tree, slots: Slots) -> None:
    """Give the slots of a block what a part has for them."""
    i, j, most = _leaf_pairs(anchors, part, slots)
    fine_a, fine_c = anchors.edges[-1], part.edges[-1]
    for g in np.unique(i):
        s, t = fine_a[g], fine_a[g + 1]
        own = np.flatnonzero((slots.owner >= s) & (slots.owner < t))
        if not len(own):
            continue
        leaves, best = j[i == g], most[i == g]
        order = np.argsort(-best)
        leaves, best = leaves[order], best[order]
        for at in range(0, len(leaves), AT_ONCE):
            if best[at] < slots.lo[own].min():
                break
            near = np.concatenate([np.arange(fine_c[c], fine_c[c + 1]) for c in leaves[at : at + AT_ONCE]])
            got = scores(anchors.x[s:t], part.x[near], anchors.most * part.most)
            owner = slots.owner[own]
            found = got[owner - s]
            alike = anchors.labels[owner][:, None] == part.labels[near][None]
            fits = (found >= slots.lo[own][:, None]) & (found <= slots.hi[own][:, None]) & (alike if slots.same else ~alike)
            if slots.same:
                fits &= anchors.rows[owner][:, None] != part.rows[near][None]
            k, m = np.nonzero(fits)
            slots.add(own[k], found[k, m], part.ids[near[m]])


def _numbers(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy(zero_copy_only=False)


def _tree(b: pa.RecordBatch, i: int, leaf: int) -> Tree:
    return Tree(_numbers(b, "ids", i), _numbers(b, "rows", i), _numbers(b, "labels", i), b.column("data")[i].as_py(), leaf)


def _visit(parts: DataFrame, routed: DataFrame, keep: int, same: bool) -> DataFrame:
    """block, slot, id, score: the best of every part for each slot of the blocks sent there. Parts stream by, blocks after their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = None, None
        for b in batches:
            for i, (kind, *at) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "leaf", "part")), strict=True)):
                if kind == 0:
                    part, place = _tree(b, i, FINE), at
                if kind == 0 or at != place:  # no row may have come to a part
                    continue
                anchors = _tree(b, i, FINE_ANCHORS)
                slots = Slots(_numbers(b, "owner", i), _numbers(b, "lo", i), _numbers(b, "hi", i), keep, same)
                search(anchors, part, slots)
                if len(slots.slot):
                    names = _numbers(b, "slots", i)
                    block = pa.array(np.full(len(slots.slot), b.column("block")[i].as_py()))
                    yield pa.RecordBatch.from_arrays([block, pa.array(names[slots.slot]), pa.array(slots.id), pa.array(slots.score)], ["block", "slot", "id", "score"])

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = parts.unionByName(routed, allowMissingColumns=True).select(*(c.split(" ")[0] for c in ROW.split(", ")))
    return met.repartition(tasks, "leaf", "part").sortWithinPartitions("leaf", "part", "kind").mapInArrow(run, "block long, slot long, id long, score long")


def _best(found: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("block", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def _packed(encoded: DataFrame, share: Column, limit: int | None, leaf: int) -> DataFrame:
    """The rows of each (leaf, share) in a tree's order, as one row, or as rows of at most ``limit``."""

    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        order = arranged(x.astype(np.float32), leaf)
        cuts = [*range(0, len(t), limit or len(t)), len(t)]
        ids, rows, labels = (t[c].to_numpy()[order] for c in ("id", "row", "label"))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        held = lambda a: pa.array([a[s:e] for s, e in spans], pa.list_(pa.int64()))
        n = len(spans)
        return pa.table({
            "leaf": pa.array([t["leaf"][0].as_py()] * n, pa.int32()), "part": pa.array([t["share"][0].as_py()] * n, pa.int32()), "ids": held(ids), "rows": held(rows),
            "labels": held(labels), "data": pa.array([_bytes(x[order[s:e]]) for s, e in spans], pa.binary()),
        })

    dealt = encoded.select("leaf", share.alias("share"), "row", "id", "label", "x")
    return dealt.groupBy("leaf", "share").applyInArrow(pack, "leaf int, part int, ids array<long>, rows array<long>, labels array<long>, data binary")


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = 256, positives: int = 5,
    negatives: int = 3, low: int = 50, high: int = 95, part_rows: int = PART_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each row where ``anchor`` holds is an anchor; its positives are the best other rows of its label. A positive's negatives are the best rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Ties go by the least key.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), label.cast("long").alias("label"),
        (F.col(key).isNotNull() & F.coalesce(anchor, F.lit(False))).alias("anchor"), F.col(vector).alias("vector"),
    )
    rows = rows.where(vectors.usable("vector", LARGEST) & F.col("label").isNotNull())
    dims, n = vectors.usual_length(rows, "vector")
    rows = rows.where(F.size("vector") == dims)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_LEAVES, max(tasks, -(-n // part_rows)), max(1, n // 256))
    leaves = 1 << (wanted - 1).bit_length()
    of_sample = rows.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(2 * SAMPLE / max(n, 1) * (1 << 20)) + 1)
    sample = of_sample.select("vector").limit(SAMPLE).toArrow()
    coarse = Coarse(vectors.matrix(sample["vector"].combine_chunks(), scale, 0, dims).astype(np.float64), leaves)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.bounded(batches, dims):
            x = vectors.matrix(b.column("vector"), scale, 0, dims)
            leaf = coarse.leaf(x)
            away = np.sqrt(((x - coarse.centres[leaf]) ** 2).sum(axis=1))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims)
            made = [pa.array(leaf.astype(np.int32)), pa.array(away), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32).ravel()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "label", "anchor")), *made], ["row", "id", "label", "anchor", "leaf", "away", "x"])

    encoded = scratch.table(rows.mapInArrow(encode, "row long, id long, label long, anchor boolean, leaf int, away double, x array<int>"), "encoded")
    about = encoded.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("away").alias("r")).collect()  # a row for each leaf
    radius, cut, cut_anchors = np.full(leaves, -1.0), np.ones(leaves, int), np.ones(leaves, int)
    for r in about:
        radius[r["leaf"]], cut[r["leaf"]], cut_anchors[r["leaf"]] = r["r"] * (1 + 1e-9), -(-r["n"] // part_rows), -(-r["anchors"] // (part_rows // 4))
    cuts = F.broadcast(spark.createDataFrame([(i, int(c), int(a)) for i, (c, a) in enumerate(zip(cut, cut_anchors, strict=True))], "leaf int, cuts int, anchor_cuts int"))
    share = lambda c: F.pmod(F.xxhash64("row"), F.greatest(F.col(c), F.lit(1))).cast("int")
    cutting = encoded.join(cuts, "leaf")
    parts = scratch.table(_packed(cutting, share("cuts"), None, FINE).withColumn("kind", F.lit(0)), "parts")
    blocks = _packed(cutting.where("anchor"), share("anchor_cuts"), BLOCK, FINE_ANCHORS).drop("part")
    blocks = scratch.table(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", encoded)
    sizes = np.sqrt((coarse.centres**2).sum(axis=1))

    def route(known: str | None, home: bool):
        """Blocks with their slots, and the leaves they have to see: with ``known`` positives for negatives, without for positives."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    tree = _tree(b, i, BLOCK)
                    if known:
                        names, p = _numbers(b, "of", i), _numbers(b, "p", i)
                        owner, lo, hi = (names // positives).astype(np.int32), -((-low * p) // 100), (high * p) // 100
                        names, owner, lo, hi = (x[lo <= hi] for x in (names, owner, lo, hi))
                    else:
                        names = np.arange(len(tree.rows)) * positives
                        owner, lo, hi = np.arange(len(tree.rows), dtype=np.int32), np.full(len(names), LOW), np.full(len(names), HIGH)
                    if not home:
                        raised = dict(zip(_numbers(b, "raised", i).tolist(), _numbers(b, "raised_to", i).tolist(), strict=True))
                        lo = np.array([max(x, raised.get(s, LOW)) for s, x in zip(names.tolist(), lo.tolist(), strict=True)], np.int64)
                    seen = [b.column("leaf")[i].as_py()]
                    if not home:
                        need_lo, need_hi = Slots(owner, lo, hi, 1, True).needs(np.array([0, len(tree.rows)]), len(tree.rows))
                        least, most = interval(tree.centres[0], tree.radii[0], tree.sizes[0], coarse.centres, radius, sizes)
                        seen = np.flatnonzero((radius >= 0) & (most >= need_lo) & (least <= need_hi)).tolist()
                    if len(names):
                        lists = [(names, pa.int64()), (owner, pa.int32()), (lo, pa.int64()), (hi, pa.int64()), (seen, pa.int32())]
                        kept = ("block", "ids", "rows", "labels", "data")
                        yield pa.RecordBatch.from_arrays(
                            [*(b.column(c).slice(i, 1) for c in kept), *(pa.array([x], pa.list_(kind)) for x, kind in lists)], [*kept, "slots", "owner", "lo", "hi", "leaves"]
                        )

        return run

    routed_as = "block long, ids array<long>, rows array<long>, labels array<long>, data binary, slots array<long>, owner array<int>, lo array<long>, hi array<long>, leaves array<int>"

    def stage(blocks: DataFrame, known: str | None, keep: int, same: bool, name: str, *used: DataFrame) -> DataFrame:
        def sent(routed: DataFrame, home: bool) -> DataFrame:
            to = routed.withColumn("leaf", F.explode("leaves")).drop("leaves").join(cuts, "leaf")
            part = F.lit(0) if home else F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
            return to.withColumn("part", part).withColumn("kind", F.lit(1)).drop("cuts", "anchor_cuts")

        first = _visit(parts, sent(blocks.mapInArrow(route(known, True), routed_as), True), keep, same)
        full = first.groupBy("block", "slot").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == keep)
        lists = full.groupBy("block").agg(F.collect_list(F.struct("slot", "s")).alias("l")).select("block", F.col("l.slot").alias("raised"), F.col("l.s").alias("raised_to"))
        none = F.array().cast("array<bigint>")
        better = blocks.join(lists, "block", "left").withColumns({c: F.coalesce(c, none) for c in ("raised", "raised_to")})
        found = _visit(parts, sent(better.mapInArrow(route(known, False), routed_as), False), keep, same)
        return scratch.table(_best(found, keep), name, *used)

    first = stage(blocks, None, positives, True, "positives")
    named = first.select("block", (F.col("slot") + F.col("rank") - 1).alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    wanted_by = named.groupBy("block").agg(F.collect_list(F.struct("slot", "positive_score")).alias("l"))
    asked = blocks.join(wanted_by.select("block", F.col("l.slot").alias("of"), F.col("l.positive_score").alias("p")), "block")
    then = stage(asked, "positives", negatives, False, "negatives", parts)
    owners = blocks.select("block", F.posexplode("ids").alias("i", "anchor"))
    real = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    met = named.join(then, ["block", "slot"]).withColumn("i", F.floor(F.col("slot") / positives).cast("int")).join(owners, ["block", "i"])
    return met.select(
        F.col("anchor").alias("anchor_id"), real("positive").alias("positive_id"), "rank", real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
