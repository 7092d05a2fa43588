import hashlib
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from deskloom.operators.scope import Scope, granted, one_spelling, open_areas, scope_in, scope_of, visible_groups
from deskloom.sources import archive as A
from deskloom.sources.store import ConcurrentCommit, Store, monthly_ranges, sheet_name, write_json, write_sheets
from deskloom.streaming import ingest as I

ROWS = "id long, username string, peer string, bare_peer string, txt string, created_at timestamp_ntz, timestamp long, xml binary"
AT = datetime(2025, 6, 2, 10)


def blob(s):
    return b"\x01\x02\x0b\x06" + bytes([len(s)]) + s.encode() + b"\x00"


def copies(i, author, to, txt, stanza, micros, both=True, second_only=False):
    first = (i, author, f"{to}@h", f"{to}@h", txt, AT, micros, blob(stanza))
    second = (i + 1, to, f"{author}@h/r", f"{author}@h", txt, AT, micros + 1500, blob(stanza))
    return [second] if second_only else [first, second] if both else [first]


def normal(spark, rows):
    return sorted(tuple(r)[1:6] for r in A.normalized(spark.createDataFrame(rows, ROWS)).collect())


def test_pairs_singles_and_outsiders(spark):
    rows = copies(1, "u", "help", " hi ", "aaaaa", 0) + copies(3, "help", "u", "yes", "bbbbb", 10, second_only=True) + copies(5, "u", "v", "private", "ccccc", 20)
    rows += copies(7, "help", "help-mag", "both sides", "ddddd", 30) + [(9, "u", "help@h", "help@h", None, AT, 40, blob("eeeee")), (10, "u", "help@h", "help@h", "  ", AT, 40, None)]
    assert normal(spark, rows) == [("u", "help", "u", "out", "yes"), ("u", "u", "help", "in", "hi")]


def test_a_single_before_a_pair_and_a_far_twin(spark):
    a, b = copies(2, "u", "help", "x", "aaaaa", 5_000_000), (1, "u", "help@h", "help@h", "other", AT, 0, blob("aaaaa"))
    assert [r[4] for r in normal(spark, [b, *a])] == ["other", "x"]
    far = [copies(1, "u", "help", "x", "aaaaa", 0)[0], (2, "help", "u@h/r", "u@h", "x", AT, 1_000_000, blob("aaaaa"))]
    assert len(normal(spark, far)) == 1  # two single rows of one message, known by their hash


def test_stanza_ids(spark):
    blobs = [blob("abc"), b"\x0b\x06\x00", b"\x0b\x06\x09abc", b"\x00\xb0\x60\x0b\x06\x01z", None, b""]
    got = spark.createDataFrame(list(enumerate(blobs)), "i int, x binary").select("i", A.stanza_id(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["abc", None, None, "z", None, None]


def test_dimensions(spark):
    users = spark.createDataFrame([("u@h", "A"), ("u@h", "A"), ("u@h", "all"), ("help@h", "help-desk"), ("help@h", "all")], "jid string, grp string")
    groups = spark.createDataFrame([("Help-Desk", '[{displayed_groups,[<<"A">>,<<"B">>,<<"help-x">>,<<"All">>]},{x,[<<"C">>]}]')], "name string, opts string")
    assert sorted(tuple(r) for r in A.desk_groups(users, groups).collect()) == [("help", "A"), ("help", "B")]
    last = spark.createDataFrame([("u", 0)], "username string, seconds long")
    got = {(r.client, r.grp): r.last_seen_at for r in A.memberships(users, last).collect()}
    assert len(got) == 4 and got["u", "A"] == datetime(1970, 1, 1) and got["help", "all"] is None


def talk(n):
    """Pairs whose first copy's peer has a resource too, single copies of either kind, and pairs cut by other rows."""
    r, rows = random.Random(5), []
    for i in range(0, 2 * n, 2):
        author, to, txt = ("u1", "help", f"почта {i}") if i % 4 else ("help", "u1", "Заявка закрыта")
        if i % 10 == 6:
            author, to, txt = ("u2", "help-mag", f"сеть {i}") if i % 20 == 6 else ("help-mag", "u2", "какой номер?")
        made = copies(i + 1, author, to, txt, f"s{i:04d}", i * 10_000_000, both=r.random() < 0.8, second_only=r.random() < 0.1)
        if len(made) == 2 and r.random() < 0.5:
            made[0] = (*made[0][:2], f"{to}@h/desktop", *made[0][3:])
        rows += made
    return rows


def test_commits_write_what_they_touch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8, keep=2)
    df = spark.createDataFrame([(f"u{i}", i) for i in range(40)], "client string, x int")
    state = store.commit(store.state(), 1, replace={"t": df}, append={"m": df})
    mine = store.bucket(F.col("client"))
    (k,) = {r[0] for r in df.where("client = 'u7'").select(mine).collect()}
    changed = df.where(mine == k).withColumn("x", F.col("x") + 100)
    state = store.commit(state, 2, rewrite={"t": (changed, [k])}, append={"m": df.limit(1)})
    assert sorted(r.x for r in store.table("t").collect()) == sorted([r.x for r in df.where(mine != k).collect()] + [r.x for r in changed.collect()])
    assert store.table("m").count() == 41 and store.table("t", buckets=[k]).count() == changed.count() and store.table("t", {**state, "version": 0}).count() == 40
    with pytest.raises(ConcurrentCommit):
        store.commit({**state, "version": 1}, 3, append={"m": df})
    assert store.table("m").count() == 41  # the second writer changed nothing
    store.compact("m")
    store.commit(store.state(), 4, replace={"t": df})
    assert store.table("m").count() == 41 and len(list((tmp_path / "s" / "log").glob("*.json"))) == 2
    assert len(list((tmp_path / "s" / "t").iterdir())) == 3 and len(list((tmp_path / "s" / "m").iterdir())) < 4  # folders that no version names are gone


def test_dimensions_and_zones(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    archive = spark.createDataFrame(copies(1, "U", "help", "почта", "aaaaa", 0), ROWS)
    dims = {"client_group": spark.createDataFrame([("u", "A")], "client string, grp string")}
    I.ingest(store, archive, dimensions=dims, source_zone="Asia/Yekaterinburg", business_zone="Europe/Moscow")
    (m,) = I.messages(store).collect()
    assert (m.client, m.created_at) == ("u", AT.replace(hour=8)) and store.table("client_group").count() == 1
    I.ingest(store, archive.limit(0), dimensions={"client_group": dims["client_group"].limit(0)})
    assert store.table("client_group").count() == 0 and store.table("message").count() == 1
    with pytest.raises(ValueError):
        A.normalized(archive, "UTC", None)


def test_identity_without_a_stanza(spark):
    times = ["2025-06-02 10:00:00", "2025-06-02 10:00:07", "2025-06-02 10:00:00.5", "2025-06-02 10:00:00.000001"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(A.iso_time(F.col("t").cast("timestamp_ntz"))).collect()
    assert [r[0] for r in got] == ["2025-06-02T10:00", "2025-06-02T10:00:07", "2025-06-02T10:00:00.500", "2025-06-02T10:00:00.000001"]
    row = spark.createDataFrame([("u", "id", "txt")], "c string, i string, t string").select(A.dedup_hash(F.col("c"), F.col("i"), F.col("t"))).first()
    assert bytes(row[0]) == hashlib.sha1(b"u\0id\0txt").digest()


def test_streaming_query(spark, tmp_path):
    archive = spark.createDataFrame(copies(1, "u", "help", "почта", "aaaaa", 0) + copies(3, "u", "help", "ещё", "bbbbb", 9_000_000), ROWS)
    archive.write.parquet(f"{tmp_path}/in")
    store, heard = Store(spark, f"file://{tmp_path}/out"), []
    I.stream(store, spark.readStream.schema(archive.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck", heard.append).awaitTermination(120)
    (t,) = I.tickets(store).collect()
    assert t.messages_in == 2 and len(heard) == 1 and heard[0]["watermark"] == 4


def test_sheets(spark, tmp_path):
    made = write_sheets({"a/b": spark.range(1), "A:B": spark.range(1), "x" * 40: spark.range(1)}, f"file://{tmp_path}")
    assert made == ["a_b", "A_B~2", "x" * 31] and sheet_name("", []) == "Sheet"
    write_sheets({"s": [("Пользователи", spark.range(2)), ("Динамика", spark.range(3))]}, f"file://{tmp_path}")
    assert spark.read.csv(f"file://{tmp_path}/s/02 Динамика", header=True).count() == 3
    write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"file://{tmp_path}/j")
    assert spark.read.text(f"file://{tmp_path}/j").first()[0] == '{"a":1,"b":null}'


def test_monthly_ranges():
    d = date
    assert monthly_ranges(d(2024, 1, 30), d(2024, 3, 1)) == [(d(2024, 1, 30), d(2024, 1, 31)), (d(2024, 2, 1), d(2024, 2, 29)), (d(2024, 3, 1), d(2024, 3, 1))]
    assert monthly_ranges(d(2024, 1, 2), d(2024, 1, 1)) == []


def test_scope(spark):
    member = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u2", "B"), ("u3", "all"), ("u4", "helpers")], "client string, grp string")
    said = spark.createDataFrame([(c, c, "help") for c in ("u1", "u2", "u3", "u4")], "client string, author string, recipient string")
    seen = lambda s: sorted(r.client for r in s.messages(said, member).collect())
    assert seen(Scope()) == [] and seen(Scope.all()) == ["u1", "u2"] and seen(Scope(groups=("A",))) == ["u1"]
    assert seen(Scope(accounts=("help",))) == ["u1", "u2"] and seen(Scope(accounts=("help",), only_group="B")) == ["u1", "u2"] and seen(Scope(accounts=("other",), groups=("all",))) == []
    tickets = said.select("client", F.lit("help").alias("account"))
    assert Scope(accounts=("help",)).tickets(tickets, member).count() == 4
    rows = [("x", "help_account", "HELP", True, False), ("x", "group", "C", True, True), ("y", "group", "c", False, True)]
    grants = spark.createDataFrame(rows, "user string, scope_type string, scope_value string, can_metrics boolean, can_chats boolean")
    desks = spark.createDataFrame([("help", "A")], "account string, grp string")
    assert sorted(map(repr, granted(grants, desks).collect())) == ["Row(user='x', account='help', grp='A')", "Row(user='x', account=None, grp='C')"]
    assert sorted(tuple(r) for r in visible_groups(grants, desks, "chats").collect()) == [("x", "c"), ("y", "c")]
    own = scope_of(grants, desks, "x")
    assert own == Scope(accounts=("help",), groups=("c",)) and scope_of(grants, desks, "y") == Scope() == scope_of(grants, desks, "nobody")
    assert own.may_report("Help") and not own.may_report("help-mag") and own.narrowed("C").only_group == "C"
    with pytest.raises(PermissionError):
        own.narrowed("B")
    assert seen(Scope(groups=("Á",))) == ["u1"] and Scope(groups=("Zoë",)).narrowed("zoe").only_group == "zoe"
    spelt = spark.createDataFrame([("u1", "Zoë"), ("u2", "zoe"), ("u2", "ZOE"), ("u3", "Zo")], "client string, grp string")
    assert sorted(map(tuple, one_spelling(spelt).collect())) == [("u1", "ZOE"), ("u2", "ZOE"), ("u3", "Zo")]
    assert seen(Scope(groups=("a",))) == ["u1"] and seen(Scope(accounts=("HELP",), only_group="b")) == ["u1", "u2"]


def test_roles_open_areas_and_grants_fill_them(spark):
    people = [("a", "admin", True), ("m", "manager", True), ("u", "user", True), ("off", "admin", False), ("odd", "guest", True), ("none", None, True), ("unsure", "admin", None)]
    accounts = spark.createDataFrame(people, "user string, role string, enabled boolean")
    tables = {"companies", "users", "groups"}
    seen = {}
    for r in open_areas(accounts).collect():
        assert r.area not in seen.setdefault(r.user, set())
        seen[r.user].add(r.area)
    assert seen == {"a": tables | {"admin", "metrics", "chat", "help"}, "m": tables | {"metrics", "chat", "help"}, "u": tables}
    rows = [("m", "group", "Org1", True, False), ("m", "group", "Org2", False, True), ("u", "help_account", "help", True, False), ("a", "group", "Org1", True, True)]
    grants = spark.createDataFrame(rows, "user string, scope_type string, scope_value string, can_metrics boolean, can_chats boolean")
    served = spark.createDataFrame([("help", "org1")], "account string, grp string")
    into = lambda user, area: scope_in(accounts, grants, served, user, area)
    assert into("a", "admin") == into("a", "companies") == Scope.all()
    assert into("m", "metrics") == Scope(groups=("org1",)) and into("m", "chat") == Scope(groups=("org2",))
    assert into("u", "companies") == Scope(accounts=("help",))
    for user, area in (("u", "metrics"), ("u", "chat"), ("m", "admin"), ("off", "users"), ("odd", "users"), ("none", "users"), ("unsure", "users"), ("nobody", "users"), ("a", "unheard")):
        with pytest.raises(PermissionError):
            into(user, area)


def test_desks_serve_the_groups_that_have_members(spark):
    from deskloom.sources.adapter import desk_groups

    member = spark.createDataFrame([("u1", "all"), ("u1", "org0"), ("u2", "org0"), ("u2", "org6"), ("u3", None)], "client string, grp string")
    assert sorted(tuple(r) for r in desk_groups(member).collect()) == [("help", "org0"), ("help-dnk", "org6")]
    assert desk_groups(member.limit(0)).count() == 0


def test_pairing_sorts_the_rows_once(spark):
    """All that pairing asks of a stanza's rows comes from one order of them, and rows without a stanza go along."""
    rows = copies(1, "u", "help", "x", "aaaaa", 0) + [(9, "u", "help@h", "help@h", "y", AT, 40, None), (10, "u", "help@h", "help@h", "y", AT, 40, None)]
    met = A.paired(A.prepared(spark.createDataFrame(rows, ROWS)))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count(" Sort [") == 1 and "Union" not in plan
    assert sorted((r.id, r.nth, r.paired, r.last) for r in met.collect()) == [(1, 1, True, False), (2, 2, False, True), (9, 1, False, True), (10, 1, False, True)]
