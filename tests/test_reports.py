import dataclasses
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from deskloom.operators import verdicts as V
from deskloom.plans import catalog, drill, metrics as M, more
from deskloom.sources.adapter import desk

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def views():
    import duckdb

    con = duckdb.connect()
    for name in ("events", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [*catalog.REPORTS, *more.REPORTS])
def test_report_equals_its_sql(spark, views, name):
    queries, sql = catalog.queries() | more.queries(), catalog.oracle_sql() | more.oracle_sql()
    df, rel = queries[name](spark, SF), views.sql(sql[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols, order = sorted(df.columns), rel.columns
    want = sorted((tuple(r[order.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_rows_add_up_to_cards(spark):
    d, p, s = desk(spark, SF), catalog.PERIOD, catalog.ALL
    total = M.summary(d, p, s).first()
    opened = M.ticket_details(d, p, s)
    assert total.opened == opened.count() and total.answered == opened.where("answered").count() and total.thanked == opened.where("thanked").count()
    closed = M.timeseries(d, p, s).agg(F.sum("closed")).first()[0]
    assert closed == M.ticket_details(d, p, s, "closed").where("status = 'closed'").count()
    by = {r.breakdown: r.c for r in drill.tally(drill.cards()["closed"], d, p, s).groupBy("breakdown").agg(F.sum("count").alias("c")).collect()}
    assert by["organisation"] == by["category"] == closed


def test_cards_agree_with_reports(spark):
    """Each card's total is the figure of its report."""
    d, p, s = desk(spark, SF), catalog.PERIOD, catalog.ALL
    fact = lambda k: {r.fact: r.value for r in drill.facts(drill.cards()[k], d, p, s).collect()}
    total, open_ = M.summary(d, p, s).first(), M.backlog(d, p, s).first()
    assert fact("open")["open"] == open_.open_tickets and fact("open")["до 1 дня"] == open_.age_day
    assert fact("unanswered")["unanswered"] == total.unanswered and fact("expired")["expired"] == total.expired
    assert fact("fast")["fast"] == total.answered_fast and fact("resolved")["day"] == total.resolved_day and fact("thanked")["thanked"] == total.thanked
    assert fact("offHours")["off_hours"] == M.off_hours_messages(d, p, s).count()


def test_filters_and_focus(spark):
    d, p, s = desk(spark, SF), catalog.PERIOD, catalog.ALL
    for k, card in drill.cards().items():
        tally = drill.tally(card, d, p, s).collect()
        for r in [r for r in tally if r.breakdown == "organisation"][:2]:
            rows = drill.population(card, d, p, s, {"organisation": r.label})
            assert rows.agg(F.sum(card.count.cast("long"))).first()[0] == r["count"]
        if card.focus is not None and card.moment is not None:
            assert drill.events(card, d, p, s).count() == drill.population(card, d, p, s).where(card.focus).count()
    ranked = drill.ranked_clients(drill.cards()["closed"], d, p, s).collect()
    assert [-r.events for r in ranked] == sorted(-r.events for r in ranked)


def test_verdicts_are_written_back_and_kept(spark):
    d = desk(spark, SF)

    def judge(before, now):
        return before.map(lambda x: "answer: same")

    n = d.ticket.where("reopen_llm = 'pending'").count()
    first = V.judged(d.ticket, d.message, judge, budget=3).persist()
    assert first.count() == min(3, n) > 0
    again = V.judged(d.ticket, d.message, judge, known=first, budget=2)
    assert again.count() == min(5, n) and again.distinct().count() == again.count()
    after = V.written_back(d.ticket, V.judged(d.ticket, d.message, judge, budget=None))
    assert after.where("reopen_llm = 'pending'").count() == 0 and after.where("reopen_llm = 'same'").count() == n and after.count() == d.ticket.count()
    assert M.reopens(dataclasses.replace(d, ticket=after), catalog.PERIOD, catalog.ALL).agg(F.sum("confirmed")).first()[0] > M.reopens(d, catalog.PERIOD, catalog.ALL).agg(F.sum("confirmed")).first()[0]
    first.unpersist()


def test_texts_are_cut_at_the_limit():
    rows = [["a" * 599, "bc", "d"], ["a" * 601], ["a", "b", "c"], ["x" * 300, "y" * 299, "z" * 9], []]
    assert [V.joined(r) for r in rows] == ["a" * 599 + "b", "a" * 600, "a\nb\nc", "x" * 300 + "\n" + "y" * 299, V.NOTHING]
    thumbs = "\U0001f44d"  # two units each
    assert V.joined([thumbs * 301]) == thumbs * 300 and V.joined(["a" + thumbs * 300]) == "a" + thumbs * 299


def test_monthly_report_files(spark, tmp_path):
    d = desk(spark, SF)
    made = M.write_help_report(d, M.Period(datetime(2024, 1, 20), datetime(2024, 2, 3)), "help", f"file://{tmp_path}")
    assert made == ["help_help_2024-01"] and (tmp_path / made[0] / "Сводка по группам").is_dir()


def test_truncated_details(spark):
    rows = M.ticket_details(desk(spark, SF), catalog.PERIOD, catalog.ALL, rows=5).collect()
    assert len(rows) == 5 and all(r.truncated for r in rows)


@pytest.mark.parametrize("name", ["open", "closed", "unanswered"])
def test_cards_count_beyond_the_lists_limits(spark, name):
    d, p, s, card = desk(spark, SF), catalog.PERIOD, catalog.ALL, drill.cards()[name]
    once = {(r.breakdown, r.label): (r["count"], r.base) for r in drill.tally(card, d, p, s).collect()}
    rows = card.rows(d, p, s).count()
    times = (1000 if name == "open" else 45_000) // rows + 2
    copy = F.col("id") + F.col("copy") * 1_000_000_000
    copies = d.ticket.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("id", copy).drop("copy")
    many = drill.tally(card, dataclasses.replace(d, ticket=copies), p, s).collect()
    assert once and {(r.breakdown, r.label): (r["count"], r.base) for r in many} == {k: (c * times, b * times) for k, (c, b) in once.items()}
