"""Benchmark passages in training texts: a broadcast hash set of the test items' word windows, probed by every window of every text.

Windows are ``size`` consecutive words of an item, or all words of an item that has fewer; a word is a run of letters, digits and characters
beyond ASCII, with A-Z in lower case. A text's windows are hashed and looked up in one scan; a hit counts only if its words are
those of the item's window, so hashes that coincide do no harm. All steps are DataFrame functions.

Rows: a null text has no words; rows with one key are rows of their own; an empty benchmark hits nothing. An item without words has no
windows; an item without id hits, but isn't listed; items of one id count once. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: what parts words, once letters are small
RAW_WORD, RAW_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
BROADCAST_WINDOWS = 200_000  # some 50 MB of windows; more are joined by a shuffle


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def item_windows(benchmark: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """item, hash, nth, window: the distinct windows of each item; ``nth`` tells windows of one hash apart."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("window")).distinct()
    of_hash = Window.partitionBy("hash").orderBy("window")
    return each.withColumn("hash", F.xxhash64("window")).withColumn("nth", F.dense_rank().over(of_hash))


def _looked_up(lengths: list[int]) -> Column:
    """For each length the hashes of a text's windows, after one null that stands for the text itself."""

    def hashes(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("__w") - (n - 1))
        found = F.when(F.size("__w") >= n, F.transform(starts, lambda i: F.xxhash64(F.slice("__w", i, n))))
        return F.concat(F.array(F.lit(None).cast("long")), F.coalesce(found, F.array().cast("array<bigint>")))

    return F.array(*(F.struct(F.lit(n).alias("n"), hashes(n).alias("hashes")) for n in lengths))


def scan(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    size: int = 10, carry: list[str] | None = None, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """A row for each document: key, n_words, n_hit (words inside hits), hits (start word from 1, n words), items (ids as strings, sorted).

    ``carry`` names columns that go along, as ``doc``. The set of windows is broadcast up to ``broadcast_windows`` of them; beyond, texts are
    written once with row numbers, hashes meet by a shuffle, and the hits' words are looked up in the written texts.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_key, item_text, size)
    known = windows.select("hash", "nth", "window").distinct()
    counts = {r["n"]: r["count"] for r in known.groupBy(F.size("window").alias("n")).count().collect()}  # at most one for each length
    lengths = sorted(counts, reverse=True) or [size]
    fits = sum(counts.values()) <= broadcast_windows
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"), F.struct(*(carry or [key])).alias("__doc")
    )
    if not fits:
        rows = scratch.table(rows, "documents")  # row numbers are to be the same in both uses
    rows = rows.withColumn("__w", words(F.col("__text"))).withColumn("__n", F.size("__w").cast("long"))
    by_length = rows.select("__row", "__key", "__doc", "__w", "__n", F.explode(_looked_up(lengths)).alias("__l"))
    looked = by_length.select(
        "__row", "__key", "__doc", "__w", "__n", F.col("__l.n").alias("__size"), F.posexplode("__l.hashes").alias("__at", "__hash")
    )
    itself = (F.col("__at") == 0) & (F.col("__size") == lengths[0])
    if fits:
        met = looked.join(F.broadcast(known), F.col("__hash") == F.col("hash"), "left")
        same = F.slice("__w", F.greatest("__at", F.lit(1)), F.col("__size")) == F.col("window")  # not a join key: that would be made for every window
        met = met.where(itself | (F.col("nth").isNotNull() & same))
        found = met.select("__row", F.when(itself, F.struct("__key", "__n", "__doc")).alias("__own"), "__at", "__size", "hash", "nth")
    else:
        near = looked.where("__at > 0").select("__row", "__at", "__size", "__hash").join(known, F.col("__hash") == F.col("hash"))
        near = near.withColumnRenamed("__row", "__of").join(rows.select("__row", "__w"), F.col("__of") == F.col("__row"))
        hits = near.where(F.slice("__w", F.col("__at"), F.col("__size")) == F.col("window"))
        nothing = lambda kind: F.lit(None).cast(kind)
        own = rows.select(
            "__row", F.struct("__key", "__n", "__doc").alias("__own"), nothing("int").alias("__at"), nothing("int").alias("__size"),
            nothing("long").alias("hash"), nothing("int").alias("nth"),
        )
        found = own.unionByName(hits.select("__row", "__at", "__size", "hash", "nth"), allowMissingColumns=True)
    is_hit = F.col("nth").isNotNull()
    by_doc = found.groupBy("__row").agg(
        F.first("__own", ignorenulls=True).alias("__own"),
        F.sort_array(F.collect_set(F.when(is_hit, F.struct(F.col("__at").alias("start"), F.col("__size").alias("n"))))).alias("hits"),
        F.collect_set(F.when(is_hit, F.struct("hash", "nth"))).alias("__windows"),
    )
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = s["start"] + s["n"] - 1
        more = F.greatest(F.lit(0), end - F.greatest(a["upto"], s["start"] - 1))
        return F.struct(F.greatest(a["upto"], end).alias("upto"), (a["n"] + more).alias("n"))

    counted = by_doc.select("__row", "__own", "hits", F.aggregate("hits", start, add, lambda a: a["n"]).alias("n_hit"), F.explode_outer("__windows").alias("__window"))
    listed = windows.where("item IS NOT NULL").groupBy("hash", "nth").agg(F.collect_set("item").alias("__items"))
    named = counted.join(
        F.broadcast(listed) if fits else listed, (F.col("__window.hash") == F.col("hash")) & (F.col("__window.nth") == F.col("nth")), "left"
    )
    whole = named.groupBy("__row").agg(
        F.first("__own").alias("__own"), F.first("hits").alias("hits"), F.first("n_hit").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("items"),
    )
    return whole.select(F.col("__own.__key").alias("key"), F.col("__own.__n").alias("n_words"), "n_hit", "hits", "items", F.col("__own.__doc").alias("doc"))


def without_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that no item's window occurs in, as they were."""
    found = scan(docs, benchmark, key=docs.columns[0], text=text, carry=docs.columns, **options)
    return found.where("n_hit = 0").select("doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Every document; of those with hits the words inside them are gone, each with what parts it from the next."""
    found = scan(docs, benchmark, key=docs.columns[0], text=text, carry=docs.columns, **options)
    old = F.col("doc").getField(text)
    tokens = F.regexp_extract_all(old, F.lit(f"({RAW_WORD}{RAW_GAP})"), 1)
    hit = F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(1), F.size(tokens)), hit)
    cut = F.concat(F.regexp_extract(old, f"^({RAW_GAP})", 1), F.array_join(F.transform(kept, lambda i: F.element_at(tokens, i)), ""))
    return found.withColumn("__cut", F.when(F.col("n_hit") > 0, cut).otherwise(old)).select(
        *(F.col("__cut").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns)
    )
