import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deskloom.operators.tickets import tickets
from deskloom.sources import archive as A, blooms
from deskloom.sources.store import ConcurrentCommit, Store
from deskloom.streaming import ingest as I

ROWS = "id long, username string, peer string, bare_peer string, txt string, created_at timestamp_ntz, timestamp long, xml binary"
AT = datetime(2025, 5, 26, 9)
IN, OUT = ["почта", "спасибо", "опять почта", "прошу пароль", "не открывается", "да"], ["Заявка закрыта", "заявка отклонена", "заявка в работе", "какой номер?"]


def blob(s):
    return b"\x01\x0b\x06" + bytes([len(s)]) + s.encode() + b"\x00"


def copy(i, owner, other, txt, stanza, at, shift=0, resource=""):
    micros = round((at - AT).total_seconds() * 1_000_000) + shift
    return (i, owner, f"{other}@h{resource}", f"{other}@h", txt, at, micros, stanza and blob(stanza))


def shuffled(n, seed, clients=4):
    """Messages whose times are in no order: pairs, single copies, copies far apart in ids, stanzas used again, rows without a stanza, repeats."""
    r, rows, i, open_ = random.Random(seed), [], 0, []
    for k in range(n):
        at = AT + timedelta(minutes=r.randrange(0, 20_000), microseconds=r.choice([0, 0, 250_000]))
        client, inbound, stanza = f"u{r.randrange(clients)}", r.random() < 0.6, f"s{k:04d}"
        author, to, txt = (client, "help", r.choice(IN)) if inbound else ("help", client, r.choice(OUT))
        if r.random() < 0.1:
            stanza = None
        first = copy(0, author, to, txt, stanza, at, 0, r.choice(["", "/pc"]))
        second = copy(0, to, author, txt, stanza, at, 1500, "/phone")
        kind = r.random()
        made = [first, second] if kind < 0.5 else [second] if kind < 0.6 else [first]
        open_ += [second] if kind >= 0.7 else []
        if r.random() < 0.1:
            made.append(copy(0, author, to, "второй текст", stanza, at, 9000))
        if r.random() < 0.15:
            made.append(r.choice(made))
        for row in made:
            rows.append((i := i + 1, *row[1:]))
        while open_ and r.random() < 0.4:
            rows.append((i := i + 1, *open_.pop(r.randrange(len(open_)))[1:]))
    return rows


def everything(messages, made):
    return [sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (messages.select(I.MESSAGE), made)]


def rebuilt(spark, rows):
    messages = A.normalized(spark.createDataFrame(rows, ROWS))
    return everything(messages, tickets(messages))


@pytest.mark.parametrize(("seed", "cuts"), [(1, [20, 21, 38]), (2, [9, 33, 46])])
def test_any_cuts_of_rows_in_any_order_of_time_equal_a_rebuild(spark, tmp_path, seed, cuts):
    rows = shuffled(36, seed)
    want = rebuilt(spark, rows)
    store, at = Store(spark, f"file://{tmp_path}/s"), 0
    for to in [*cuts, len(rows)]:
        I.ingest(store, spark.createDataFrame(rows[at:to], ROWS))
        at = to
        if to == cuts[1]:
            I.compact(store)
    assert everything(I.messages(store), I.tickets(store)) == want and len(want[1]) > 3
    again = store.state()
    assert I.ingest(store, spark.createDataFrame(rows[-9:], ROWS))["version"] == again["version"]  # rows seen before change nothing


def test_a_late_second_copy_replaces_the_message(spark, tmp_path):
    """The first peer has a resource, so its row alone looks as if the desk had written it; its partner comes after a much later row."""
    rows = [copy(1, "v", "help", "почта", "aaaa", AT + timedelta(seconds=100)), copy(2, "u", "help", "почта", "bbbb", AT, 0, "/pc"), copy(3, "help", "u", "почта", "bbbb", AT, 1500, "/pc")]
    store = Store(spark, f"file://{tmp_path}/s")
    I.catch_up(store, spark.createDataFrame(rows, ROWS), rows=2)
    first = store.table("message").where("client = 'u'").first()
    assert (first.author, first.direction) == ("help", "out")
    (now,) = I.messages(store).where("client = 'u'").collect()
    assert (now.author, now.direction, now.dedup_hash) == ("u", "in", first.dedup_hash) and I.tickets(store).count() == 2
    assert everything(I.messages(store), I.tickets(store)) == rebuilt(spark, rows)


def in_time(first, n, clients=6, start=AT):
    rows = []
    for k in range(first, first + n):
        client = f"u{k % clients}"
        author, to, txt = (client, "help", IN[k % len(IN)]) if k % 3 else ("help", client, OUT[k % len(OUT)])
        rows.append(copy(k, author, to, txt, f"s{k:05d}", start + timedelta(minutes=11 * k)))
    return rows


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_a_batch_writes_in_proportion_to_itself_and_reads_no_old_message(spark, tmp_path, monkeypatch):
    store, wrote = Store(spark, f"file://{tmp_path}/s", keep=99), []
    I.ingest(store, spark.createDataFrame(in_time(1, 4000, clients=900), ROWS))
    read = monkeypatch.setattr(I, "messages", lambda *a: pytest.fail("read old messages")) or 4001
    whole = size(tmp_path / "s")
    for _ in range(2):
        before = size(tmp_path / "s")
        I.ingest(store, spark.createDataFrame(in_time(read, 30, clients=6), ROWS))
        wrote.append(size(tmp_path / "s") - before)
        read += 30
    assert max(wrote) < 1.3 * min(wrote) and max(wrote) < whole / 5
    monkeypatch.undo()
    want = rebuilt(spark, in_time(1, 4000, clients=900) + [x for k in (4001, 4031) for x in in_time(k, 30, clients=6)])
    assert everything(I.messages(store), I.tickets(store)) == want


def test_a_late_row_reads_from_the_state_before_it(spark, tmp_path, monkeypatch):
    store, rows = Store(spark, f"file://{tmp_path}/s", keep=99), []
    for k in range(2):
        rows += in_time(1 + 60 * k, 60)
        I.ingest(store, spark.createDataFrame(rows[60 * k :], ROWS))
    seen, whole = [], I.T.signal_columns

    def placed(df):
        seen.append(df.count())
        return whole(df)

    monkeypatch.setattr(I.T, "signal_columns", placed)
    rows.append(copy(200, "u1", "help", "опять почта", "late1", AT + timedelta(minutes=11 * 85)))
    I.ingest(store, spark.createDataFrame(rows[-1:], ROWS))
    mine = [r for r in rows if (r[1] if r[1] != "help" else r[3].split("@")[0]) == "u1"]
    assert seen[0] == sum(r[0] > 60 for r in mine) < len(mine)  # back to the state after the first batch
    assert everything(I.messages(store), I.tickets(store)) == rebuilt(spark, rows)
    rows.append(copy(201, "u1", "help", "да", "late2", AT - timedelta(days=1)))
    I.ingest(store, spark.createDataFrame(rows[-1:], ROWS))
    assert seen[2] == len(mine) + 1 and everything(I.messages(store), I.tickets(store)) == rebuilt(spark, rows)


def test_parts_without_a_hit_are_not_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", keep=99)
    for k in range(3):
        I.ingest(store, spark.createDataFrame(in_time(1 + 20 * k, 20), ROWS))
    seen = store.table("seen")
    asked = seen.where("source_id IN (25, 31)").select("dedup_hash").unionByName(spark.range(5000).select(F.unhex(F.sha1(F.col("id").cast("string"))).alias("dedup_hash")))
    parts = [at for at, *_ in store.state()["tables"]["seen"]]
    assert store.hits("seen", asked, "dedup_hash") == [(parts[1], 0)]
    assert sorted(r.source_id for r in store.find("seen", asked, "dedup_hash").collect()) == [25, 31]
    assert store.find("seen", asked.where("false"), "dedup_hash") is None


def test_filters_hold_what_they_were_made_of():
    import numpy as np

    r = np.random.default_rng(5)
    h = r.integers(-(1 << 63), (1 << 63) - 1, 200_000)
    for n in (1, 7, 1000, 60_000):
        made = blooms.made(h[:n])
        assert blooms.holds(made, h[:n]).all() and blooms.holds(made, h[n:]).sum() == 0 and len(made) <= max(128, 10 * n)


def test_filters_take_a_bounded_number_of_keys_at_once(monkeypatch):
    """However many keys a slice has or is asked for, the bits of only so many are numbered at once."""
    import numpy as np

    sizes, places = [], blooms._places
    monkeypatch.setattr(blooms, "_places", lambda h, bits: sizes.append(len(h)) or places(h, bits))
    h = np.random.default_rng(6).integers(-(1 << 63), (1 << 63) - 1, 150_000)
    assert blooms.holds(blooms.made(h[:100_000]), h).sum() == 100_000 and max(sizes) <= 1 << 15


def test_a_part_of_few_slices_is_asked_in_shares(spark, tmp_path, monkeypatch):
    """Filters of a part with one slice meet many keys in several groups, and say the same."""
    monkeypatch.setattr(blooms, "SLICE_ROWS", 100)
    groups, cogroup = [], type(spark.range(1).groupBy("id")).cogroup
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "cogroup", lambda a, b: groups.append(b._df) or cogroup(a, b))
    known = spark.createDataFrame([("a", 1, 0, blooms_of(range(3))), ("b", 1, 0, blooms_of(range(5000, 5003)))], "part string, slices int, slice int, bits binary")
    assert blooms.hits(known, spark.range(2, 1000).select(F.col("id").alias("h")), [1]) == [("a", 0)]
    largest = groups[0].groupBy("slices", "slice", "share").count().agg(F.max("count")).first()[0]
    assert largest < 200
    assert blooms.hits(known, spark.range(0).select(F.col("id").alias("h")), [1]) == []


def blooms_of(keys):
    import numpy as np

    return blooms.made(np.asarray(list(keys), np.int64))


def test_a_month_and_a_table_without_clients_are_written_by_many_tasks(spark, tmp_path):
    """Rows of one month, and tickets, which have no column of clients, don't all go through one task."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        store = Store(spark, f"file://{tmp_path}/s")
        rows = spark.range(0, 40_000, 1, 8).select("id", F.sha1(F.col("id").cast("string")).alias("txt"), F.lit(AT).alias("created_at"))
        state = store.commit(store.state(), 0, replace={"message": rows, "ticket": rows}, months={"message": "created_at"})
        for name in ("message", "ticket"):
            assert store.table(name, state).select(F.input_file_name()).distinct().count() > 3 and store.table(name, state).count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_a_rebuild_takes_the_place_of_all_tables_in_one_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", keep=99)
    rows = shuffled(12, 5)
    archive = spark.createDataFrame(rows, ROWS)
    I.catch_up(store, archive)
    before = store.state()
    I.catch_up(store, archive, rebuild=True)
    after = store.state()
    assert after["version"] == before["version"] + 1 and everything(I.messages(store), I.tickets(store)) == rebuilt(spark, rows)
    assert everything(I.messages(store, before), I.tickets(store, before)) == everything(I.messages(store), I.tickets(store))
    shrunk = archive.where("id <= 7")
    assert I.catch_up(store, shrunk)["watermark"] == 7 and everything(I.messages(store), I.tickets(store)) == rebuilt(spark, rows[:7])
    assert I.catch_up(store, archive.where("false"))["watermark"] == -1 and I.messages(store).count() == 0 == I.tickets(store).count()
    with pytest.raises(ConcurrentCommit):
        store.commit(before, 0)
