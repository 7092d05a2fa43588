import pickle
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from deskloom.operators import tickets as T

DAY = datetime(2026, 3, 2)  # a Monday
M = "source_id long, client string, author string, recipient string, direction string, txt string, created_at timestamp_ntz"


def script(*lines):
    """(time as 'day hh:mm', from client?, text)"""
    out = []
    for i, (at, inbound, txt) in enumerate(lines, 1):
        day, clock = at.split()
        h, m = map(int, clock.split(":"))
        a, b = ("u", "help") if inbound else ("help", "u")
        out.append((i, "u", a, b, "in" if inbound else "out", txt, DAY.replace(day=DAY.day + int(day), hour=h, minute=m)))
    return out


def run(spark, *lines):
    return sorted(T.tickets(spark.createDataFrame(script(*lines), M)).collect(), key=lambda t: t.id)


def test_answer_and_close(spark):
    (t,) = run(spark, ("0 09:00", 1, "Не печатает принтер"), ("0 09:10", 0, "Заявка в работе"), ("0 09:40", 0, "Заявка закрыта"))
    assert (t.status, t.frt_seconds, t.pickup_seconds, t.resolution_seconds, t.category, t.messages_out, t.closed_by) == ("closed", 600, 600, 2400, "Печать", 2, "help")


def test_thanks_open_nothing(spark):
    (t,) = run(spark, ("0 09:00", 1, "почта"), ("0 09:40", 0, "Заявка закрыта"), ("0 09:45", 1, "спасибо"), ("1 09:45", 1, "👍"))
    assert t.thanked and t.messages_in == 1


def test_late_short_answer_is_a_ticket_but_late_thanks_are_not(spark):
    got = run(spark, ("0 09:00", 1, "почта"), ("0 09:40", 0, "Заявка закрыта"), ("2 09:45", 1, "abc"))
    assert len(got) == 2


def test_answer_to_an_operators_question_is_a_ticket(spark):
    got = run(spark, ("0 09:00", 1, "почта"), ("0 09:40", 0, "Заявка закрыта"), ("0 09:50", 0, "Какой у вас номер?"), ("0 10:30", 1, "да"))
    assert len(got) == 2


def test_a_task_gives_few_batches_whatever_its_clients():
    """One batch for the clients that end within a batch, not one for each of them; messages without a state may have an empty one."""
    import pyarrow as pa

    n = 500
    kinds = {"client": pa.string(), "author": pa.string(), "recipient": pa.string(), "source_id": pa.int64(), "at": pa.int64(), "b": pa.int64(), "rank": pa.int32(), "said": pa.int32()}
    values = {"client": [f"u{i:03d}" for i in range(n)], "author": ["u"] * n, "recipient": ["help"] * n, "rank": [14] * n, "said": [T.IN] * n}
    batch = pa.RecordBatch.from_pydict({c: pa.array(values.get(c, range(n)), kind) for c, kind in kinds.items()})
    states = pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in kinds}, "state": pa.array([[]] * n, pa.list_(pa.int64()))})
    for given_batch, given_states in ((batch, False), (states, True)):
        got = list(T.fold(iter([given_batch]), given_states))
        assert len(got) == 3
        rows = pa.Table.from_batches(got).to_pylist()
        ended = [r for r in rows if r["state"] is not None]
        assert [r["client"] for r in ended] == values["client"] and [r["ticket"] for r in ended] == list(range(n)) and len(rows) == 2 * n


def test_resume_within_a_quarter(spark):
    (t,) = run(spark, ("0 09:00", 1, "почта"), ("0 09:40", 0, "Заявка закрыта"), ("0 09:55", 1, "не открывается"), ("0 10:00", 0, "Заявка закрыта"))
    assert (t.resumes, t.status, t.resolution_seconds, t.replies, t.reply_seconds) == (1, "closed", 3600, 1, 300)
    assert len(run(spark, ("0 09:00", 1, "почта"), ("0 09:40", 0, "Заявка закрыта"), ("0 09:56", 1, "не открывается"))) == 2


def test_expiry_is_strict_and_links_the_next(spark):
    at = lambda m: run(spark, ("0 09:00", 1, "почта"), ("0 09:30", 0, "смотрим"), (f"2 09:{m}", 1, "опять почта"))
    assert len(at("30")) == 1
    old, new = at("31")
    assert (old.status, new.reopened_from, new.reopen_score, new.reopen_llm) == ("expired", old.id, 3, None)
    assert old.stale_at == DAY.replace(day=4, hour=9, minute=30)


def test_operator_revives_a_stale_ticket(spark):
    (t,) = run(spark, ("0 09:00", 1, "почта"), ("9 09:00", 0, "Заявка закрыта"))
    assert t.status == "closed"


def test_unlike_topic_waits_for_a_verdict(spark):
    _, t = run(spark, ("0 09:00", 1, "почта"), ("0 09:10", 0, "Заявка закрыта"), ("0 09:30", 1, "прошу пароль"))
    assert (t.reopen_score, t.reopen_llm) == (0, "pending")


PHRASES = ["почта", "спасибо", "опять почта", "прошу пароль", "не открывается", "да", "👍"], ["Заявка закрыта", "заявка отклонена", "заявка в работе", "какой номер?", "обращайтесь"]


@pytest.fixture(scope="module")
def signals(spark):
    rows = [(f"{i}{x}", "u", "u", "help", "in" if i == 0 else "out", x, DAY) for i in (0, 1) for x in PHRASES[i]]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], M)
    return {rows[r["source_id"]][0]: r for r in (x.asDict() for x in T.signal_columns(df).collect())}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4000), st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40), st.integers(0, 40))
def test_restart_changes_nothing(signals, steps, cut):
    """Places found with the state pickled and read again at any message are the same; an inbound message is in at most one ticket."""
    rows, minute = [], 0
    for i, (gap, side, x) in enumerate(steps):
        minute += gap
        day, m = divmod(minute, 1440)
        week, weekday = divmod(day, 7)
        b = week * 180_000 + min(weekday, 5) * 36_000 + (0 if weekday >= 5 else min(max(m * 60, 28_800), 64_800) - 28_800)
        r = signals[f"{side}{PHRASES[side][x % len(PHRASES[side])]}"]
        rows.append((i, minute * 60_000_000, b, r["rank"], r["said"]))
    whole, state = T.Places(), T.Places()
    want, got = [whole.place(*r) for r in rows], []
    for i, r in enumerate(rows):
        state = pickle.loads(pickle.dumps(state)) if i == cut else state
        got.append(state.place(*r))
    assert got == want
    for r, places in zip(rows, want):
        assert len({t for t, p, *_ in places if p <= T.RESUMES}) <= (r[4] & T.IN)
    opened = [t for places in want for t, p, *_ in places if p == T.OPENS]
    assert len(opened) == len(set(opened)) and all(t in opened for places in want for t, *_ in places)


def test_fractions_of_a_second_order_messages(spark):
    """Closed at 10.1 s, the client is back at 10.9 s with a lower id: the ticket is open again, and times keep their fractions."""
    at = lambda s: DAY.replace(hour=10, second=int(s), microsecond=round(s % 1 * 1_000_000))
    rows = [(1, "u", "u", "help", "in", "почта", at(0.25)), (5, "u", "help", "u", "out", "Заявка закрыта", at(10.1)), (3, "u", "u", "help", "in", "не открывается", at(10.9))]
    rows += [(9, "u", "help-b", "u", "out", "какой номер?", at(11.2)), (8, "u", "help-a", "u", "out", "смотрим", at(11.3))]
    (t,) = T.tickets(spark.createDataFrame(rows, M)).collect()
    assert (t.status, t.resumes, t.first_responder, t.opened_at, t.last_activity, t.closed_at, t.desk_authors) == ("open", 1, "help", at(0.25), at(11.3), None, 3)
    one = T.tickets(spark.createDataFrame([rows[0], *rows[3:]], M)).first()
    assert (one.first_responder, one.first_response_at) == ("help-b", at(11.2))


def test_states_and_parts_take_up_where_a_pass_ended(spark):
    """Messages placed in two passes, the second from stored states, with tickets merged from parts, give what one pass gives."""
    r, rows, when = random.Random(7), [], DAY
    for i in range(500):
        side, client, when = r.random() < 0.5, f"u{r.randrange(5)}", when + timedelta(minutes=r.choice([1, 7, 300]))
        rows.append((i, client, client if side else "help", "help" if side else client, "in" if side else "out", r.choice(PHRASES[0 if side else 1]), when))
    s = T.signal_columns(spark.createDataFrame(rows, M)).persist()
    early = T.folded(s.where("source_id < 230")).persist()
    states = early.where("state IS NOT NULL")
    late = T.folded(s.where("source_id >= 230"), states.select("client", "state")).persist()
    parts = [T.accumulated(f.where("state IS NULL")) for f in (early, late)]
    want = sorted(map(repr, T.gathered(T.placed(s)).collect()))
    assert sorted(map(repr, T.finished(T.merged(*parts)).collect())) == want and len(want) > 40
    last = {x.client: (x["at"], x.source_id) for x in late.where("state IS NOT NULL").collect()}
    assert last == {x.client: tuple(x.p) for x in s.groupBy("client").agg(F.max(F.struct("at", "source_id")).alias("p")).collect()}


def test_tasks_and_order_of_input_change_nothing(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        side = r.random() < 0.5
        client, text = f"u{r.randrange(6)}", r.choice(PHRASES[0 if side else 1])
        rows.append((i, client, client if side else "help", "help" if side else client, "in" if side else "out", text, DAY + timedelta(minutes=20 * i)))
    df = spark.createDataFrame(rows, M)
    one = sorted(map(repr, T.gathered(T.placed(T.signal_columns(df), 1)).collect()))
    assert len(one) > 30
    r.shuffle(rows)
    assert sorted(map(repr, T.gathered(T.placed(T.signal_columns(spark.createDataFrame(rows, M).repartition(7)), 5)).collect())) == one
