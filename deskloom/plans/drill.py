"""The drill-down cards: rows behind a figure, tallied by organisation and by each breakdown's label.

Each card gives (breakdown, label, count, base). Rows without a base are no part of a card that shows a rate, and a row
without a label is left out of that breakdown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import working_time as W
from ..operators.scope import Scope
from ..sources.adapter import Desk
from . import metrics as M

# fixed values: labels and upper bounds
NO_GROUP, NOBODY = "Без организации", "никто"
FRT = [(300, "до 5 мин"), (900, "5-15 мин"), (3600, "15-60 мин"), (14_400, "1-4 ч"), (None, "больше 4 ч")]
RESOLUTION = [(3600, "до 1 ч"), (14_400, "1-4 ч"), (36_000, "4 ч - 1 раб. день"), (180_000, "1-5 раб. дней"), (None, "больше 5 раб. дней")]
AGE = [(1, "до 1 дня"), (3, "2-3 дня"), (7, "4-7 дней"), (30, "8-30 дней"), (None, "больше месяца")]
ARRIVAL = {"weekend": "выходные", "night": "будни, вечер и ночь", "working": "рабочее время"}
OUTCOME = {"open": "так и не закрыта", "closed": "закрыта позже", "rejected": "отклонена позже", "expired": "истекла позже"}
SILENT = ("поддержка, ни разу", "поддержка, на последнее", "клиент")


def histogram(c: str, bounds: list) -> Column:
    """The label of the first bound that holds the value; null stays null."""
    out = F.lit(bounds[-1][1])
    for most, label in reversed(bounds[:-1]):
        out = F.when(F.col(c) <= most, label).otherwise(out)
    return F.when(F.col(c).isNotNull(), out)


def named(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c)


@dataclass(frozen=True)
class Card:
    rows: Callable[[Desk, M.Period, Scope], DataFrame]
    count: Column
    base: Column | None = None
    breakdowns: dict[str, Column] = field(default_factory=dict)
    facts: dict[str, Column] = field(default_factory=dict)  # aggregates over the card's rows
    focus: Column | None = None  # the rows that the list shows at first
    moment: Column | None = None  # the time of what such a row counts


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5))


def _median(c: str, where: str = "true") -> Column:
    return F.round(F.percentile(F.when(F.expr(where), F.col(c)), F.lit(0.5)), 6)


def _opened(d: Desk, p: M.Period, s: Scope) -> DataFrame:
    return M.ticket_details(d, p, s, rows=None)


def _open(d: Desk, p: M.Period, s: Scope) -> DataFrame:
    return M.backlog_tickets(d, p, s, rows=None)


def _closed(status: str) -> Callable:
    return lambda d, p, s: M.ticket_details(d, p, s, "closed", rows=None).where(F.col("status") == status)


def cards() -> dict[str, Card]:
    flag, one = (lambda c: F.when(F.expr(c), 1).otherwise(0)), F.lit(1)
    category, by, first = F.col("category"), F.col("closed_by"), F.coalesce("first_responder", F.lit(NOBODY))
    silent = F.when(F.col("no_reply"), SILENT[0]).when(F.col("awaiting"), SILENT[1]).otherwise(SILENT[2])
    res = histogram("resolution_seconds", RESOLUTION)
    return {
        "messages": Card(M.client_messages, F.expr("messages_in + messages_out"), facts=_message_facts()),
        "offHours": Card(
            M.client_messages, F.expr("off_hours_night + off_hours_weekend"), F.col("messages_in"),
            facts=_off_hours_facts(), focus=F.expr("off_hours_night + off_hours_weekend > 0")
        ),
        "closed": Card(
            _closed("closed"), one, None, {"closed_by": by, "resolution": res, "category": category}, _closed_facts(),
            moment=F.col("closed_at")
        ),
        "rejected": Card(
            _closed("rejected"), one, None, {"closed_by": by, "category": category}, {"rejected": F.count("*")},
            moment=F.col("closed_at")
        ),
        "open": Card(
            _open,
            one,
            None,
            {"age": histogram("age_days", AGE), "category": category, "first": first, "outcome": named(F.col("final_status"), OUTCOME)},
            _open_facts(),
        ),
        "unanswered": Card(
            _opened,
            flag("no_reply"),
            flag("status <> 'open'"),
            {"arrival": named(W.arrival_class(F.col("opened_at")), ARRIVAL), "category": category},
            _unanswered_facts(),
            F.col("no_reply"),
            F.col("opened_at"),
        ),
        "expired": Card(
            _opened,
            flag("status = 'expired'"),
            one,
            {"silent": F.when(F.col("status") == "expired", silent), "first": first, "category": category},
            _expired_facts(),
            F.col("status") == "expired",
            F.col("last_activity"),
        ),
        "fast": Card(
            _opened, flag("answered_fast"), flag("answered"), {"frt": histogram("frt_seconds", FRT), "first": first},
            _fast_facts(), ~F.col("answered_fast"), F.col("opened_at")
        ),
        "resolved": Card(
            _opened, flag("resolved_hour"), flag("resolved"), {"resolution": res, "closed_by": by}, _resolved_facts(),
            ~F.col("resolved_hour"), F.col("opened_at")
        ),
        "thanked": Card(
            _opened, flag("thanked"), flag("status = 'closed'"), {"closed_by": by, "category": category},
            _thanked_facts(), F.col("thanked"), F.col("closed_at")
        ),
    }


def _message_facts() -> dict[str, Column]:
    both = M.total(F.col("messages_in") + F.col("messages_out"))
    return {
        "total": both, "from_clients": M.total("messages_in"), "from_clients_pct": _share(M.total("messages_in"), both),
        "from_support": M.total("messages_out"), "clients": F.count("*")
    }


def _off_hours_facts() -> dict[str, Column]:
    off = M.total(F.col("off_hours_night") + F.col("off_hours_weekend"))
    return {
        "off_hours": off, "off_hours_pct": _share(off, M.total("messages_in")), "night": M.total("off_hours_night"),
        "weekend": M.total("off_hours_weekend"), "incoming": M.total("messages_in")
    }


def _closed_facts() -> dict[str, Column]:
    all_, thanked, again = F.count("*"), M.n(F.col("thanked")), M.n(F.col("reopened"))
    return {
        "closed": all_, "median_resolution": _median("resolution_seconds", "resolved"), "thanked": thanked,
        "thanked_pct": _share(thanked, all_), "reopened": again, "reopened_pct": _share(again, all_)
    }


def _open_facts() -> dict[str, Column]:
    ages = {label: M.n(histogram("age_days", AGE) == label) for _, label in AGE}
    return {"open": F.count("*"), **ages, "oldest_day": F.unix_date(F.to_date(F.min("opened_at")))}


def _unanswered_facts() -> dict[str, Column]:
    hits, off = M.n(F.col("no_reply")), M.n(F.col("no_reply") & W.off_hours(F.col("opened_at")))
    return {"unanswered": hits, "unanswered_pct": _share(hits, F.count("*")), "off_hours_pct": _share(off, hits)}


def _expired_facts() -> dict[str, Column]:
    gone = F.col("status") == "expired"
    hits, client = M.n(gone), M.n(gone & ~F.col("no_reply") & ~F.col("awaiting"))
    return {
        "expired": hits,
        "expired_pct": _share(hits, F.count("*")),
        "support_silent": hits - client,
        "support_silent_pct": _share(hits - client, hits),
        "client_silent": client,
        "client_silent_pct": _share(client, hits),
    }


def _fast_facts() -> dict[str, Column]:
    fast, hour, all_ = M.n(F.col("answered_fast")), M.n(F.col("answered_hour")), F.count("*")
    return {
        "fast": fast, "fast_pct": _share(fast, all_), "hour": hour, "hour_pct": _share(hour, all_),
        "median_frt": _median("frt_seconds"), "answered": all_
    }


def _resolved_facts() -> dict[str, Column]:
    hour, day, all_ = M.n(F.col("resolved_hour")), M.n(F.col("resolved_day")), F.count("*")
    return {
        "hour": hour, "hour_pct": _share(hour, all_), "day": day, "day_pct": _share(day, all_),
        "median_resolution": _median("resolution_seconds"), "resolved": all_
    }


def _thanked_facts() -> dict[str, Column]:
    return {"thanked": M.n(F.col("thanked")), "thanked_pct": _share(M.n(F.col("thanked")), F.count("*")), "closed": F.count("*")}


def population(card: Card, desk: Desk, p: M.Period, scope: Scope, only: dict[str, str] | None = None) -> DataFrame:
    """The card's rows; ``only`` keeps those with a label in a breakdown."""
    rows = card.rows(desk, p, scope)
    rows = rows if card.base is None else rows.where(card.base > 0)
    for breakdown, label in (only or {}).items():
        rows = rows.where(
            F.coalesce("group_names", F.lit(NO_GROUP)) == label if breakdown == "organisation" else card.breakdowns[breakdown] == label
        )
    return rows


def facts(card: Card, desk: Desk, p: M.Period, scope: Scope, only: dict[str, str] | None = None) -> DataFrame:
    """(fact, value) of a card, in one pass over its rows."""
    one = population(card, desk, p, scope, only).agg(*(c.cast("double").alias(f"f{i}") for i, c in enumerate(card.facts.values())))
    lines = F.array(*(F.struct(F.lit(k).alias("fact"), F.col(f"f{i}").alias("value")) for i, k in enumerate(card.facts)))
    return one.select(F.inline(lines))


def events(card: Card, desk: Desk, p: M.Period, scope: Scope, only: dict[str, str] | None = None) -> DataFrame:
    """(client, group_names, at): the moments that the card's list steps through."""
    rows = population(card, desk, p, scope, only)
    rows = rows if card.focus is None else rows.where(card.focus)
    return rows.select("client", "group_names", F.coalesce(card.moment, F.col("opened_at")).alias("at"))


def every_event(desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    """(card, client, group_names, at) of all cards that have moments: each cohort is made once, and a row gives a line for each card that it counts for."""
    out = None
    for cohort in ("closed", "opened"):
        lines = []
        for name, card in cards().items():
            ends = name in ("closed", "rejected")
            if card.moment is None or ends != (cohort == "closed"):
                continue
            counts = (F.col("status") == name) if ends else F.lit(True)
            for test in ([] if card.base is None else [card.base > 0]) + ([] if card.focus is None else [card.focus]):
                counts = counts & test
            lines.append(F.when(counts, F.struct(F.lit(name).alias("card"), F.coalesce(card.moment, F.col("opened_at")).alias("at"))))
        rows = M.ticket_details(desk, p, scope, cohort, rows=None)
        found = rows.select("client", "group_names", F.explode(F.array_compact(F.array(*lines))).alias("e")).select("e.card", "client", "group_names", "e.at")
        out = found if out is None else out.unionByName(found)
    return out


def ranked_clients(card: Card, desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    """client, group_names, events: who has most of them first, names in the order of their numbers."""
    from .dashboard import by_number

    by = events(card, desk, p, scope).groupBy("client").agg(F.first("group_names").alias("group_names"), F.count("*").alias("events"))
    return by.orderBy(F.desc("events"), by_number(F.col("client")))


def tally(card: Card, desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    """One pass: each row gives a line for every breakdown it has a label in, summed before the shuffle."""
    labels = {"organisation": F.coalesce("group_names", F.lit(NO_GROUP)), **card.breakdowns}
    lines = F.array(*(F.struct(F.lit(k).alias("breakdown"), c.alias("label")) for k, c in labels.items()))
    rows = card.rows(desk, p, scope).select(
        card.count.cast("long").alias("count"),
        (card.base if card.base is not None else F.lit(0)).cast("long").alias("base"), lines.alias("lines")
    )
    rows = rows.where("base > 0") if card.base is not None else rows
    flat = rows.select(
        "count", "base", F.explode("lines").alias("line")
    ).select("count", "base", "line.breakdown", "line.label").where("label IS NOT NULL")
    return flat.groupBy("breakdown", "label").agg(M.total("count").alias("count"), M.total("base").alias("base"))
