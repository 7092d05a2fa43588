"""Incremental ingest: new archive rows become messages, and tickets go on from where they stood.

Rows come in id order, as an archive numbers them; rows at or below the watermark have been seen. The result doesn't depend on where rows are cut
into batches, nor on their times: it is that of all rows at once.

* **Halves.** A copy without a partner is a message at once, and waits in ``half`` by its stanza. When the other copy comes, in whatever batch, the
  message is replaced if its author changes, and its client's tickets are placed again from there.
* **Seen hashes.** A message whose hash is in ``seen`` is dropped. Both tables, and ``state``, are sliced by key with filters: only parts that may hold
  a batch's keys are read.
* **States.** Each batch leaves, for each client it touches, what the fold knows after the client's last message, with the parts of the latest ticket. The
  next batch takes up there and reads no message that is stored. A message older than the client's last goes back to the last state before it, and
  the client's messages since then are read and placed again; states and tickets made after that point are void.
* **Tickets** are rows by version; a batch appends the tickets it changed, and readers take the latest of each. ``compact`` makes one part of each table.

A batch writes rows in proportion to itself and its clients, whatever the tables hold. All of a batch is one commit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import tickets as T
from ..sources.archive import authored, first_of_hash, paired, prepared
from ..sources.store import Store

MOST_PARTS, STATES = 200, 8  # parts of a table before it is compacted, states of a client that compaction keeps
KEYS, MONTHS = {"half": "stanza", "seen": "dedup_hash", "state": "client"}, {"message": "created_at"}
MESSAGE = ["source_id", "client", "author", "recipient", "direction", "txt", "created_at", "dedup_hash"]
HALF = ["id", "username", "peer", "bare_peer", "txt", "created_at", "timestamp", "stanza"]


def _at(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the greatest version of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "version").alias("row")).select("row.*")


def messages(store: Store, state: dict | None = None, months: tuple[str, str] | None = None) -> DataFrame | None:
    """The stored messages, replaced ones as they are now; only those of the months asked for."""
    state = state or store.state()
    own, fixed = store.table("message", state, months=months), store.table("fixed", state)
    if own is None or fixed is None:
        return own
    fixed = _latest(fixed, "dedup_hash").select(MESSAGE)
    if months:
        fixed = fixed.where(F.date_format("created_at", "yyyy-MM").between(*months))
    return own.join(fixed.select("dedup_hash"), "dedup_hash", "left_anti").select(MESSAGE).unionByName(fixed)


def ticket_parts(store: Store, state: dict | None = None) -> DataFrame | None:
    """ticket, its parts, version, gone: of each ticket the latest."""
    rows = store.table("ticket", state or store.state())
    return None if rows is None else _latest(rows, "ticket").where("NOT gone")


def tickets(store: Store, state: dict | None = None) -> DataFrame | None:
    rows = ticket_parts(store, state)
    return None if rows is None else T.finished(rows)


def _starts(found: DataFrame | None, touched: DataFrame) -> DataFrame:
    """For each touched client (client, first: the least place of its new messages): newest, the last place known before, and start: the
    last valid state before ``first``, with the ticket's parts. A state is void if a later one of its client was made from a place before it."""
    if found is None:
        return touched.withColumns({"newest": F.lit(None).cast("struct<at:bigint,id:bigint>"), "start": F.lit(None).cast(START)})
    later = Window.partitionBy("client").orderBy(F.desc("version")).rowsBetween(Window.unboundedPreceding, -1)
    valid = found.withColumn("limit", F.min("base").over(later)).where("limit IS NULL OR place <= limit")
    met = valid.join(touched, "client")
    before = F.when(F.col("place") < F.col("first"), F.struct("place", "state"))
    per = met.groupBy("client").agg(
        F.max_by("place", "version").alias("newest"), F.max(before).alias("s"), F.max_by("parts", F.when(F.col("place") < F.col("first"), F.col("place"))).alias("parts")
    )
    start = F.when(F.col("s").isNotNull(), F.struct(F.col("s.place").alias("place"), F.col("s.state").alias("state"), F.col("parts")))
    return touched.join(per.select("client", "newest", start.alias("start")), "client", "left")


PARTS = "struct<" + ",".join([
    "ticket:bigint", "first:struct<client:string,recipient:string,link:bigint,score:int>", "opened:bigint", "opened_b:bigint", "active:bigint", "active_b:bigint",
    "answer:struct<at:bigint,source_id:bigint,b:bigint,author:string>", "progress:bigint", "progress_b:bigint",
    "last:struct<at:bigint,source_id:bigint,place:int,b:bigint,author:string,rejected:boolean>", "wait:struct<at:bigint,source_id:bigint,since:bigint>", "expired:bigint",
    "category_rank:int", "messages_in:bigint", "messages_out:bigint", "thanked:bigint", "replies:bigint", "reply_seconds:bigint", "resumes:bigint", "authors:array<string>",
]) + ">"
START = f"struct<place:struct<at:bigint,id:bigint>,state:array<bigint>,parts:{PARTS}>"


def ingest(
    store: Store, batch: DataFrame, dimensions: dict[str, DataFrame] | None = None, source_zone: str | None = None, business_zone: str | None = None, fresh: bool = False
) -> dict:
    """Apply a batch of archive rows and return the new state; ``dimensions`` replace tables of that name as a whole.

    ``fresh``: the batch is the whole archive, and what is made of it takes the place of all tables in one commit.
    """
    base = store.state()
    state = base | {"tables": {}, "watermark": -1} if fresh else base
    batch = batch.where(F.col("id") > state["watermark"]).dropDuplicates(["id"])
    top = batch.agg(F.max("id")).first()[0]
    if top is None and not fresh:
        return store.commit(base, base["watermark"], replace=dimensions) if dimensions else base
    version, work = base["version"] + 1, store.workspace()
    keep = work.table  # written, so that later steps start from files: executors may be lost, and plans stay small
    try:
        rows = keep(prepared(batch, source_zone, business_zone))
        halves = store.find("half", rows.where("stanza IS NOT NULL").select("stanza"), "stanza", state)
        all_rows = rows.withColumn("old", F.lit(False))
        if halves is not None:
            waiting = _latest(halves.withColumn("version", F.col("id")), "stanza").where("open").select(HALF)
            all_rows = all_rows.unionByName(waiting.withColumn("old", F.lit(True)))
        met = keep(paired(all_rows))
        odd = F.col("nth") % 2 == 1
        of_stanza = met.where("stanza IS NOT NULL").withColumn("had", F.max("old").over(Window.partitionBy("stanza")))
        ends = keep(of_stanza.where("last").select(*HALF, odd.alias("open"), "had").where("open OR had").drop("had"))
        made = authored(met.where(odd), "old", "paired").where("NOT old OR (paired AND author <> alone)")
        made = keep(first_of_hash(made))
        seen = store.find("seen", made.select("dedup_hash"), "dedup_hash", state)
        if seen is None:
            changed = keep(made.where("NOT old").select(MESSAGE).withColumn("fixes", F.lit(False)))
        else:
            own = made.join(seen.select("dedup_hash", F.col("source_id").alias("known")), "dedup_hash", "left")
            changed = own.where("(known IS NULL AND NOT old) OR (old AND known = source_id)").select(*MESSAGE, F.col("old").alias("fixes"))
            changed = keep(changed)
        place = F.struct(_at(F.col("created_at")).alias("at"), F.col("source_id").alias("id"))
        touched = changed.groupBy("client").agg(F.min(place).alias("first"))
        starts = keep(_starts(store.find("state", changed.select("client"), "client", state), touched))
        late = starts.where("newest IS NOT NULL AND newest >= first").select("client", "start")
        new, fixes, newest = changed.agg(F.count_if(~F.col("fixes")), F.count_if("fixes"), F.max("created_at")).first()
        back, earliest = late.agg(F.count("*"), F.min(F.coalesce(F.col("start.place.at"), F.lit(0)))).first()
        to_place, gone = changed.select(MESSAGE), None
        if back:
            from_month = (datetime(1970, 1, 1) + timedelta(microseconds=earliest) - timedelta(days=1)).strftime("%Y-%m")
            after = F.col("start").isNull() | (place > F.struct(F.col("start.place.at").alias("at"), F.col("start.place.id").alias("id")))
            stored = messages(store, state, (from_month, "9999-12")).join(late, "client").where(after).select(MESSAGE)
            to_place = stored.join(changed.select("dedup_hash"), "dedup_hash", "left_anti").select(MESSAGE).unionByName(to_place)
            opened = F.struct(F.col("opened").alias("at"), F.col("ticket").alias("id"))
            void = F.col("start").isNull() | (opened > F.struct(F.col("start.place.at").alias("at"), F.col("start.place.id").alias("id")))
            gone = ticket_parts(store, state).withColumn("client", F.col("first.client")).join(late, "client").where(void).drop("client", "start")
        fold = keep(T.folded(T.signal_columns(to_place), starts.where("start IS NOT NULL").select("client", F.col("start.state").alias("state"))))
        parts = keep(T.merged(T.accumulated(fold.where("state IS NULL")), starts.where("start.parts IS NOT NULL").select("start.parts.*")))
        rows_of_tickets = parts.withColumns({"version": F.lit(version), "gone": F.lit(False)})
        if gone is not None:
            gone = gone.join(parts.select("ticket"), "ticket", "left_anti").select(rows_of_tickets.columns).withColumns({"version": F.lit(version), "gone": F.lit(True)})
            rows_of_tickets = rows_of_tickets.unionByName(gone)
        ended = fold.where("state IS NOT NULL").select("client", "ticket", "state", F.struct("at", F.col("source_id").alias("id")).alias("place"))
        whole = parts.select(F.col("ticket"), F.struct(*parts.columns).alias("parts"))
        nowhere = F.struct(F.lit(-(1 << 62)).cast("long").alias("at"), F.lit(0).cast("long").alias("id"))
        states = keep(ended.join(whole, "ticket", "left").join(starts.select("client", "start"), "client", "left").select(
            "client", "state", "place", "parts", F.coalesce("start.place", nowhere).alias("base"), F.lit(version).alias("version")
        ))
        made_now = {
            "message": changed.where("NOT fixes").select(MESSAGE), "fixed": changed.where("fixes").select(*MESSAGE, F.lit(version).alias("version")), "half": ends,
            "seen": changed.where("NOT fixes").select("dedup_hash", "source_id"), "state": states, "ticket": rows_of_tickets,
        }
        if not fresh:
            some = {"message": new, "seen": new, "fixed": fixes, "state": new + fixes, "ticket": new + fixes, "half": not ends.isEmpty()}
            idle = [k for k, n in some.items() if not n and k in base["tables"]]
            made_now = {k: v for k, v in made_now.items() if k not in idle}
        known = None if fresh else base.get("facts", {}).get("newest")
        facts = {"newest": max(filter(None, (known, str(newest) if newest else None)), default=None)}
        into = {"replace": {**made_now, **(dimensions or {})}} if fresh else {"append": made_now, "replace": dimensions}
        top = max(state["watermark"], top if top is not None else -1)
        state = store.commit(base, top, keys=KEYS, months=MONTHS, facts=facts, **into)
    finally:
        work.drop()
    return compact(store) if any(len(p) > MOST_PARTS for p in state["tables"].values()) else state


def compact(store: Store) -> dict:
    """One part for each table: messages with what replaced them, tickets as they are, halves that still wait, and the last states of each client."""
    base = store.state()
    if "ticket" not in base["tables"]:
        return base
    states = store.table("state", base)
    later = Window.partitionBy("client").orderBy(F.desc("version"))
    valid = states.withColumn("limit", F.min("base").over(later.rowsBetween(Window.unboundedPreceding, -1))).where("limit IS NULL OR place <= limit")
    kept = valid.withColumn("nth", F.row_number().over(later)).where(F.col("nth") <= STATES).drop("nth", "limit")
    half = store.table("half", base)
    waiting = _latest(half.withColumn("version", F.col("id")), "stanza").where("open").select(half.columns)
    made = {
        "message": messages(store, base), "fixed": store.table("fixed", base).limit(0), "half": waiting, "seen": store.table("seen", base), "state": kept,
        "ticket": ticket_parts(store, base),
    }
    return store.commit(base, base["watermark"], replace=made, keys=KEYS, months=MONTHS)


def catch_up(store: Store, archive: DataFrame, rows: int = 20_000, rebuild: bool = False, **options) -> dict:
    """All rows above the watermark, in batches by id; all of the archive in one commit if asked, or if the archive has shrunk."""
    state, top = store.state(), archive.agg(F.max("id")).first()[0]
    if rebuild or top is None or top < state["watermark"]:
        return ingest(store, archive, fresh=True, **options)
    while state["watermark"] < top:
        above = archive.where(F.col("id") > state["watermark"])
        last = above.select("id").orderBy("id").limit(rows).agg(F.max("id")).first()[0]
        state = ingest(store, above.where(F.col("id") <= last), **options)
    return state


def stream(store: Store, archive: DataFrame, checkpoint: str, after: Callable[[dict], None] | None = None, **options):
    """A streaming query over a streaming archive frame; each micro-batch is one ``ingest``, then ``after`` hears of the new state."""

    def apply(batch: DataFrame, _: int) -> None:
        state = ingest(store, batch, **options)
        if after is not None:
            after(state)

    return archive.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
