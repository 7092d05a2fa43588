import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskloom.operators import verdicts as V
from deskloom.plans import catalog, metrics as M
from deskloom.sources.adapter import desk

SF = "/root/testdata/sf0.001"


def counting(path, fail_at=None):
    """A judge that leaves a file line for each call, wherever it runs."""

    def judge(before: pd.Series, now: pd.Series) -> pd.Series:
        assert len(before) == len(now) == 1
        with open(path, "a") as f:
            f.write(f"{time.time()}\n")
        if fail_at is not None and len(open(path).readlines()) >= fail_at:
            raise RuntimeError("no answer")
        return now.map(lambda x: "SAME" if len(x) % 2 else "no idea")

    return judge


def calls(path):
    return [float(x) for x in path.read_text().split()] if path.exists() else []


def test_calls_equal_pending_tickets_over_two_reports(spark, tmp_path):
    d, path = desk(spark, SF), tmp_path / "calls"
    pending = d.ticket.where("reopen_llm = 'pending'").count()
    ledger = V.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.ask(d.ticket, d.message, counting(path), budget=None) == pending == len(calls(path)) > 5
    after = V.written_back(d.ticket, ledger.known())
    for _ in range(2):
        M.reopens(type(d)(d.message, after, d.member, d.horizon, d.folder), catalog.PERIOD, catalog.ALL).collect()
    assert ledger.ask(d.ticket, d.message, counting(path), budget=None) == 0 and len(calls(path)) == pending
    assert after.where("reopen_llm = 'pending'").count() == 0


def test_a_failure_leaves_the_rest_pending(spark, tmp_path):
    d, path = desk(spark, SF), tmp_path / "calls"
    ledger = V.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.ask(d.ticket, d.message, counting(path, fail_at=4), budget=10, per_minute=60_000) == 3
    assert len(calls(path)) == 4 and ledger.known().count() == 3  # the three before it are written
    assert ledger.ask(d.ticket, d.message, counting(tmp_path / "again"), budget=5, per_minute=60_000) == 5 == len(calls(tmp_path / "again"))
    least = {(r.client, r.opened_at) for r in d.ticket.where("reopen_llm = 'pending'").orderBy("id").limit(9).collect()}
    assert {(r.client, r.opened_at) for r in ledger.known().collect()} <= least


def test_calls_keep_their_distance(spark, tmp_path):
    d, path = desk(spark, SF), tmp_path / "calls"
    V.Ledger(spark, f"file://{tmp_path}/ledger").ask(d.ticket, d.message, counting(path), budget=4, per_minute=150)
    at = calls(path)
    assert len(at) == 4 and all(b - a > 0.38 for a, b in zip(at, at[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_first_texts_like_a_loop(spark, seed):
    """Many open and overlapping spans of one client, ties of time, spans without a message."""
    r, start = random.Random(seed), datetime(2025, 1, 6)
    said = [(i, f"u{r.randrange(3)}", "in" if r.random() < 0.7 else "out", f"text {i}", start + timedelta(minutes=r.randrange(60))) for i in range(120)]
    spans = []
    for i in range(40):
        a = start + timedelta(minutes=r.randrange(70))
        spans.append((i, r.choice(["before", "now"]), f"u{r.randrange(4)}", a, r.choice([None, a, a + timedelta(minutes=r.randrange(30))])))
    got = V.first_texts(
        spark.createDataFrame(spans, "id long, side string, client string, start timestamp_ntz, end timestamp_ntz"),
        spark.createDataFrame(said, "source_id long, client string, direction string, txt string, created_at timestamp_ntz"),
    )
    want = []
    for i, side, c, a, b in spans:
        mine = sorted((t, k, x) for k, who, way, x, t in said if who == c and way == "in" and t >= a and (b is None or t <= b))
        want.append((i, side, "\n".join(x for _, _, x in mine[:3]) or V.NOTHING))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_only_asked_tickets_are_looked_up(spark):
    d = desk(spark, SF)
    asked = d.ticket.where("reopen_llm = 'pending'").orderBy("id").limit(2)
    some = V.candidates(d.ticket, d.message, asked)
    whole = {r.id: r for r in V.candidates(d.ticket, d.message).collect()}
    got = some.collect()
    assert len(got) == 2 and all(whole[r.id] == r for r in got)
    assert d.message.join(some.select("client").distinct(), "client").agg(F.count("*")).first()[0] < d.message.count()


def test_what_a_batch_decides_is_one_frame_and_stays_when_a_call_fails():
    part, asked = pd.DataFrame({"client": [f"u{i}" for i in range(50)], "opened_at": range(50), "before": "x", "now": [f"n{i}" for i in range(50)]}), []

    def judge(before, now):
        assert len(now) == 1
        asked.append(now.iloc[0])
        if now.iloc[0] == "n30":
            raise OSError
        return pd.Series(["same" if int(now.iloc[0][1:]) % 2 else None])

    got = list(V._asking(judge, None)(iter([part, part])))
    assert len(got) == 1 and list(got[0]["client"]) == [f"u{i}" for i in range(30)] and list(got[0]["verdict"]) == ["new", "same"] * 15
    assert asked == [f"n{i}" for i in range(31)]
