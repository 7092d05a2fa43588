"""Period reports. Each takes the desk's tables, a period [start, end) and a scope, and returns a DataFrame.

Facts are aggregated before they meet dimensions; percentiles are exact grouped aggregates; the data horizon is a
literal, so that range filters reach the scans. Sums over no rows are 0, flags are never null.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import working_time as W
from ..operators.scope import Scope, among, real_group
from ..sources.adapter import Desk
from ..sources.store import monthly_ranges, write_sheets

# fixed values
MAX_FRT, MAX_RESOLUTION, FAST, HOUR, DAY = 36_000, 180_000, 900, 3_600, 36_000
SPIKE_MESSAGES, SPIKE_RATIO, SLA_TICKETS, SLA_RATIO = 30, 2.0, 10, 2.0
TOP_CLIENTS, BACKLOG_ROWS, DETAIL_ROWS = 20, 1000, 45_000


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime  # exclusive

    def holds(self, t: Column, end: Column | None = None) -> Column:
        return (t >= F.lit(self.start)) & (t < (F.lit(self.end) if end is None else end))

    def capped(self, desk: Desk) -> Column:
        """The end, or just after the last message where that is earlier."""
        return F.lit(self.end if desk.horizon is None else min(self.end, desk.horizon))


def n(cond: Column) -> Column:
    """How often a condition holds; unknown counts as no, and no rows give 0."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def total(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def mean(c: Column | str) -> Column:
    return F.round(F.avg(c), 6)


def at(c: Column | str, q: float) -> Column:
    return F.round(F.percentile(c, F.lit(q)), 6)


def probable() -> Column:
    return F.coalesce((F.col("reopen_score") > 0) | (F.col("reopen_llm") == "same"), F.lit(False))


def confirmed() -> Column:
    return F.coalesce((F.col("reopen_score") >= 2) | (F.col("reopen_llm") == "same"), F.lit(False))


def until() -> Column:
    return F.coalesce("closed_at", "stale_at")


def group_names(member: DataFrame) -> DataFrame:
    """client, group_names: the real groups of a client in order."""
    real = member.where(real_group(F.col("grp")))
    return real.groupBy("client").agg(F.array_join(F.sort_array(F.collect_set("grp")), ", ").alias("group_names"))


def still_open(desk: Desk, p: Period) -> Column:
    return (F.col("status") == "open") & (F.col("stale_at") >= p.capped(desk))


def returned(desk: Desk, scope: Scope) -> DataFrame:
    """id of tickets that a visible ticket probably continues."""
    return scope.tickets(desk.ticket, desk.member).where(probable()).select(
        F.col("reopened_from").alias("id"), F.lit(True).alias("reopened")
    ).distinct()


def timeseries(desk: Desk, p: Period, scope: Scope, unit: str = "day") -> DataFrame:
    end, messages, tickets = p.capped(desk), scope.messages(desk.message, desk.member), scope.tickets(desk.ticket, desk.member)
    names = ("messages", "closed", "rejected", "opened", "resolved")

    def part(rows: DataFrame, t: Column, **made: Column) -> DataFrame:
        rows = rows.where(p.holds(t, end)).select(W.bucket(t, unit).alias("bucket"), *(made.get(x, F.lit(0)).alias(x) for x in names))
        return rows.groupBy("bucket").agg(*(total(x).alias(x) for x in names))

    one, closed = F.lit(1), F.col("closed_at")
    parts = part(messages, F.col("created_at"), messages=one).unionByName(
        part(tickets, F.col("opened_at"), opened=one)
    ).unionByName(part(tickets, until(), resolved=one))
    parts = parts.unionByName(
        part(tickets, closed, closed=(F.col("status") == "closed").cast("int"), rejected=(F.col("status") == "rejected").cast("int"))
    )
    base = tickets.agg(n((F.col("opened_at") < F.lit(p.start)) & (until() >= F.lit(p.start))).alias("before"))
    by = parts.groupBy("bucket").agg(*(total(x).alias(x) for x in names))
    running = F.sum(F.col("opened") - F.col("resolved")).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # a row for each bucket
    return by.crossJoin(F.broadcast(base)).select("bucket", "messages", "closed", "rejected", (F.col("before") + running).alias("backlog"))


def backlog(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    end = p.capped(desk)
    age = F.datediff(end, "opened_at")
    held = scope.tickets(desk.ticket, desk.member).where((F.col("opened_at") < end) & (until() >= end))
    as_of = end if desk.horizon is None or p.end < desk.horizon else end - F.expr("INTERVAL 1 SECOND")
    return held.agg(
        F.count("*").alias("open_tickets"), n(age <= 1).alias("age_day"), n(age.between(2, 3)).alias("age_three_days"),
        n(age.between(4, 7)).alias("age_week"), n(age.between(8, 30)).alias("age_month"),
        n(age > 30).alias("age_older"), F.min("opened_at").alias("oldest_opened_at"),
    ).select(as_of.alias("as_of"), "*")


def backlog_tickets(desk: Desk, p: Period, scope: Scope, rows: int | None = BACKLOG_ROWS) -> DataFrame:
    """The newest tickets that are open at the end of the period; all of them if ``rows`` is None."""
    end = p.capped(desk)
    held = scope.tickets(desk.ticket, desk.member).where((F.col("opened_at") < end) & (until() >= end))
    held = held if rows is None else held.orderBy(F.desc("opened_at"), F.desc("id")).limit(rows)
    held = held.join(group_names(desk.member), "client", "left")
    return held.select(
        "client", "group_names", "opened_at", F.datediff(end, "opened_at").alias("age_days"), "last_activity",
        "category", "messages_in", "messages_out", "first_responder", F.col("status").alias("final_status"), "closed_at"
    )


def heatmap(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    t = F.col("created_at")
    rows = scope.messages(desk.message.where(p.holds(t)), desk.member)
    return rows.groupBy(F.weekday(t).alias("weekday"), F.hour(t).alias("hour")).agg(F.count("*").alias("messages"))


def _spread(rows: DataFrame, by: Column | str, c: str, count: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias(count), mean(c).alias("avg_seconds"), at(c, 0.5).alias("p50_seconds"),
        at(c, 0.9).alias("p90_seconds")
    )


def sla(desk: Desk, p: Period, scope: Scope, unit: str = "day") -> DataFrame:
    t = W.next_working_day(F.col("opened_at"))
    rows = scope.tickets(desk.ticket, desk.member).where(p.holds(t) & (F.col("frt_seconds") <= MAX_FRT))
    return _spread(rows, W.bucket(t, unit).alias("bucket"), "frt_seconds", "responses")


def resolution(desk: Desk, p: Period, scope: Scope, unit: str = "day") -> DataFrame:
    t = W.next_working_day(F.col("closed_at"))
    rows = scope.tickets(desk.ticket, desk.member).where(
        p.holds(t) & (F.col("status") == "closed") & (F.col("resolution_seconds") <= MAX_RESOLUTION)
    )
    return _spread(rows, W.bucket(t, unit).alias("bucket"), "resolution_seconds", "resolved")


def _reopen_parts(rows: DataFrame, p: Period, key_closed: Column, key_opened: Column, name: str) -> DataFrame:
    zero = F.lit(0)
    ended = rows.where(p.holds(F.col("closed_at")) & F.col("status").isin("closed", "rejected")).select(
        key_closed.alias(name), F.lit(1).alias("closed"), zero.alias("probable"), zero.alias("confirmed")
    )
    again = rows.where(p.holds(F.col("opened_at")) & probable()).select(
        key_opened.alias(name), zero.alias("closed"), F.lit(1).alias("probable"),
        confirmed().cast("int").alias("confirmed")
    )
    return ended.unionByName(again).groupBy(name).agg(*(total(x).alias(x) for x in ("closed", "probable", "confirmed")))


def reopens(desk: Desk, p: Period, scope: Scope, unit: str = "day") -> DataFrame:
    rows = scope.tickets(desk.ticket, desk.member)
    return _reopen_parts(rows, p, W.bucket(F.col("closed_at"), unit), W.bucket(F.col("opened_at"), unit), "bucket")


def categories(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    rows = scope.tickets(desk.ticket, desk.member).where(p.holds(F.col("opened_at")))
    solved = F.when((F.col("status") == "closed") & (F.col("resolution_seconds") <= MAX_RESOLUTION), F.col("resolution_seconds"))
    return rows.groupBy("category").agg(
        F.count("*").alias("requests"), at(
            F.when(F.col("frt_seconds") <= MAX_FRT, F.col("frt_seconds")), 0.5
        ).alias("p50_frt_seconds"), at(solved, 0.5).alias("p50_resolution_seconds"),
        mean(F.col("messages_in") + F.col("messages_out")).alias("avg_messages"), n(probable()).alias("reopens"), n(
            F.col("first_response_at").isNull() & ~still_open(desk, p)
        ).alias("unanswered"),
    )


def category_timeseries(desk: Desk, p: Period, scope: Scope, unit: str = "day") -> DataFrame:
    rows = scope.tickets(desk.ticket, desk.member).where(p.holds(F.col("opened_at")))
    return rows.groupBy(W.bucket(F.col("opened_at"), unit).alias("bucket"), "category").agg(F.count("*").alias("requests"))


def summary(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    rows = scope.tickets(desk.ticket, desk.member).where(p.holds(F.col("opened_at"))).withColumn("still_open", still_open(desk, p))
    known = desk.ticket.where(F.col("opened_at") < F.lit(p.start)).select("client", F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "client", "left")
    frt, res, closed = F.col("frt_seconds"), F.col("resolution_seconds"), F.col("status") == "closed"
    msgs, open_ = F.col("messages_in") + F.col("messages_out"), F.col("still_open")
    own = rows.agg(
        F.count("*").alias("opened"), n(closed).alias("closed"), n(F.col("status") == "rejected").alias("rejected"), n(
            F.col("status").isin("expired", "open") & ~open_
        ).alias("expired"), n(open_).alias("still_open"),
        n(
            F.col("first_response_at").isNull() & ~open_
        ).alias("unanswered"), n(frt <= MAX_FRT).alias("answered"), n(frt <= FAST).alias("answered_fast"), n(frt <= HOUR).alias("answered_hour"),
        n(closed & (res <= MAX_RESOLUTION)).alias("resolved"), n(closed & (res <= HOUR)).alias("resolved_hour"), n(closed & (res <= DAY)).alias("resolved_day"), n(
            F.col("in_progress_at").isNotNull()
        ).alias("in_progress"),
        mean("pickup_seconds").alias("avg_pickup_seconds"), n(F.col("thanked") & closed).alias("thanked"),
        total("replies").alias("replies"), total("reply_seconds").alias("reply_seconds"),
        mean(msgs).alias("avg_messages"), at(msgs, 0.5).alias("p50_messages"), at(msgs, 0.9).alias("p90_messages"),
        n(F.col("desk_authors") > 1).alias("handoffs"), F.count_distinct("client").alias("clients"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("client"))).alias("new_clients"),
    )
    arrived = scope.messages(desk.message.where((F.col("direction") == "in") & p.holds(F.col("created_at"))), desk.member)
    return own.crossJoin(arrived.agg(F.count("*").alias("incoming"), n(W.off_hours(F.col("created_at"))).alias("off_hours")))


def ticket_details(
    desk: Desk, p: Period, scope: Scope, cohort: str = "opened", client: str | None = None,
    rows: int | None = DETAIL_ROWS
) -> DataFrame:
    """Tickets opened, or closed, in the period with the flags that reports count; ``truncated`` if there were more.

    Without ``rows`` every ticket is there."""
    t = scope.tickets(desk.ticket, desk.member)
    t = t.where(p.holds(F.col("opened_at")) if cohort == "opened" else p.holds(F.col("closed_at"), p.capped(desk)))
    t = t if client is None else t.where(F.col("client") == client)
    if rows is None:
        t = t.withColumn("truncated", F.lit(False))
    else:
        order = [F.desc("opened_at"), F.desc("id")]
        newest, one = t.orderBy(*order).limit(rows + 1), Window.partitionBy(F.lit(0))  # no more rows than the list may have
        newest = newest.withColumn("truncated", F.count("*").over(one) > rows).withColumn("nth", F.row_number().over(one.orderBy(*order)))
        t = newest.where(F.col("nth") <= rows).drop("nth")
    t = t.join(returned(desk, scope), "id", "left").join(group_names(desk.member), "client", "left")
    frt, res, closed, open_ = F.col("frt_seconds"), F.col("resolution_seconds"), F.col("status") == "closed", still_open(desk, p)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return t.select(
        "client", "group_names", "opened_at", "last_activity", "closed_at", F.when(open_, "open").when(
            F.col("status").isin("expired", "open"), "expired"
        ).otherwise(F.col("status")).alias("status"),
        "category", "messages_in", "messages_out", "first_responder", "frt_seconds", "closed_by", "resolution_seconds",
        F.col("first_response_at").isNull().alias("no_reply"),
        F.col("awaiting_since").isNotNull().alias("awaiting"), (F.col("thanked") & closed).alias("thanked"),
        yes(F.col("reopened")).alias("reopened"), yes(frt <= MAX_FRT).alias("answered"),
        yes(frt <= FAST).alias("answered_fast"), yes(frt <= HOUR).alias("answered_hour"), yes(
            closed & (res <= MAX_RESOLUTION)
        ).alias("resolved"), yes(closed & (res <= HOUR)).alias("resolved_hour"),
        yes(closed & (res <= DAY)).alias("resolved_day"), "truncated",
    )


def client_messages(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    t, inbound = F.col("created_at"), F.col("direction") == "in"
    rows = scope.messages(desk.message.where(p.holds(t, p.capped(desk))), desk.member)
    by = rows.groupBy("client").agg(
        n(inbound).alias("messages_in"), n(~inbound).alias("messages_out"), n(
            inbound & (F.weekday(t) < 5) & W.off_hours(t)
        ).alias("off_hours_night"), n(inbound & (F.weekday(t) >= 5)).alias("off_hours_weekend")
    )
    return by.join(group_names(desk.member), "client", "left").select(
        "client", "group_names", "messages_in", "messages_out", "off_hours_night", "off_hours_weekend"
    )


def off_hours_messages(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    t = F.col("created_at")
    rows = scope.messages(desk.message.where((F.col("direction") == "in") & p.holds(t, p.capped(desk)) & W.off_hours(t)), desk.member)
    return rows.join(group_names(desk.member), "client", "left").select("client", "group_names", t.alias("at"))


def clients(desk: Desk, p: Period, scope: Scope, rows: int = TOP_CLIENTS) -> DataFrame:
    t = scope.tickets(desk.ticket, desk.member).where(p.holds(F.col("opened_at")))
    top = t.groupBy("client").agg(
        F.count("*").alias("tickets"), total(F.col("messages_in") + F.col("messages_out")).alias("messages"),
        n(probable()).alias("reopens")
    )
    top = top.orderBy(F.desc("tickets"), F.desc("messages"), "client").limit(rows)
    known = desk.ticket.where(F.col("opened_at") < F.lit(p.start)).select("client", F.lit(True).alias("known")).distinct()
    return top.join(known, "client", "left").join(group_names(desk.member), "client", "left").select(
        "client", "group_names", "tickets", "messages", "reopens", F.col("known").isNull().alias("new_client")
    )


def operators(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    said = scope.messages(desk.message.where((F.col("direction") == "out") & p.holds(F.col("created_at"))), desk.member)
    said = said.groupBy(F.col("author").alias("operator")).agg(F.count("*").alias("messages"), F.count_distinct("client").alias("clients"))
    t, closed = scope.tickets(desk.ticket, desk.member), F.col("status") == "closed"
    ends = t.where(p.holds(F.col("closed_at"))).join(returned(desk, scope), "id", "left").groupBy(F.col("closed_by").alias("operator"))
    ends = ends.agg(
        n(closed).alias("closed"), n(F.col("status") == "rejected").alias("rejected"),
        n(F.col("thanked") & closed).alias("thanked"), n(F.col("reopened")).alias("reopened")
    )
    first = t.where(
        p.holds(F.col("opened_at")) & (F.col("frt_seconds") <= MAX_FRT)
    ).groupBy(F.col("first_responder").alias("operator")).agg(mean("frt_seconds").alias("avg_reply_seconds"))
    both = said.join(ends, "operator", "left").join(first, "operator", "left").fillna(0, ["closed", "rejected", "thanked", "reopened"])
    both = both.select("operator", "messages", "closed", "rejected", "reopened", "thanked", "clients", "avg_reply_seconds")
    return both.orderBy(F.desc("closed"), F.desc("messages"), "operator")


def groups(desk: Desk, scope: Scope) -> DataFrame:
    return scope.group_rows(desk.member).where(real_group(F.col("grp"))).select(F.col("grp").alias("group_name")).distinct()


def _by_client(desk: Desk, p: Period, scope: Scope) -> tuple[DataFrame, DataFrame]:
    said = scope.messages(desk.message.where(p.holds(F.col("created_at"))), desk.member).groupBy("client").agg(F.count("*").alias("total"))
    end, inside = p.capped(desk), p.holds(F.col("closed_at"))
    facts = scope.tickets(desk.ticket, desk.member).groupBy("client").agg(
        n((F.col("status") == "closed") & inside).alias("closed"), n((F.col("status") == "rejected") & inside).alias("rejected"), n(
            (F.col("opened_at") < end) & (until() >= end)
        ).alias("open_at_end")
    )
    return said, facts


def companies(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    said, facts = _by_client(desk, p, scope)
    rows = scope.group_rows(desk.member).where(real_group(F.col("grp"))).join(said, "client", "left").join(facts, "client", "left")
    return rows.groupBy(F.col("grp").alias("group_name")).agg(
        F.count_distinct(
            F.when(F.col("total").isNotNull(), F.col("client"))
        ).alias("active_users"), F.count_distinct("client").alias("total_users"), total("closed").alias("closed_requests"),
        total("rejected").alias("rejected_requests"), total("open_at_end").alias("open_requests"), total("total").alias("total_messages"),
    ).where("total_messages > 0")


def users(desk: Desk, p: Period, scope: Scope, group: str) -> DataFrame:
    said, facts = _by_client(desk, p, scope)
    rows = desk.member.where(F.col("grp") == group).join(said, "client", "left").join(facts, "client", "left").fillna(
        0, ["closed", "rejected", "open_at_end", "total"]
    )
    return rows.select(
        F.col("client").alias("user_name"), "last_seen_at", F.col("closed").alias("closed_requests"),
        F.col("rejected").alias("rejected_requests"), F.col("open_at_end").alias("open_requests"),
        F.col("total").alias("total_messages")
    )


def chat(desk: Desk, p: Period, scope: Scope, client: str | None = None) -> DataFrame:
    rows = scope.messages(desk.message.where(p.holds(F.col("created_at"))), desk.member)
    rows = rows if client is None else rows.where(F.col("client") == client)
    return rows.select(
        "client", F.col("author").alias("sender"), "recipient", "direction", F.col("txt").alias("message"),
        "created_at", "source_id"
    ).orderBy("created_at", "source_id").drop("source_id")


def chat_participants(desk: Desk, p: Period, scope: Scope) -> DataFrame:
    rows = scope.messages(desk.message.where(p.holds(F.col("created_at"))), desk.member)
    last = F.max(F.struct("created_at", "source_id", "txt", "direction"))  # combined before the shuffle, unlike a row number
    by = rows.groupBy("client").agg(F.count("*").alias("messages"), last.alias("last"))
    return by.select(
        "client", F.col("last.created_at").alias("last_at"), "messages",
        F.left("last.txt", F.lit(140)).alias("last_text"), F.col("last.direction").alias("last_direction")
    )


def chat_tickets(desk: Desk, p: Period, scope: Scope, client: str) -> DataFrame:
    rows = scope.tickets(desk.ticket.where(F.col("client") == client), desk.member)
    rows = rows.where((F.col("opened_at") < F.lit(p.end)) & (F.coalesce("closed_at", "last_activity") >= F.lit(p.start)))
    return rows.select(
        "opened_at", "in_progress_at", "closed_at", "last_activity", "status", "category", "frt_seconds",
        "resolution_seconds", "closed_by", probable().alias("reopen"), "thanked"
    )


def help_accounts(desk: Desk, scope: Scope = Scope.all()) -> DataFrame:
    """Desks that have written or been written to, of those that may be reported on."""
    out = desk.message.where("direction = 'out'").select(F.col("author").alias("account"))
    found = out.union(desk.message.where("direction = 'in'").select("recipient")).distinct()
    return found if scope.everything else found.where(among(F.col("account"), scope.accounts))


def _real(desk: Desk) -> DataFrame:
    return desk.member.where(real_group(F.col("grp"))).select("client", F.col("grp").alias("group_name"))


def _of_desk(desk: Desk, p: Period, account: str, scope: Scope) -> DataFrame:
    party = ((F.col("direction") == "out") & (F.col("author") == account)) | (
        (F.col("direction") == "in") & (F.col("recipient") == account)
    )
    return desk.message.where(p.holds(F.col("created_at")) & party & F.lit(scope.may_report(account)))


def help_users(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    said = _of_desk(desk, p, account, scope).groupBy("client").agg(F.count("*").alias("total_messages"))
    inside = p.holds(F.col("closed_at"))
    facts = desk.ticket.where(F.col("account") == account).groupBy("client").agg(
        n((F.col("status") == "closed") & inside).alias("closed_requests"),
        n((F.col("status") == "rejected") & inside).alias("rejected_requests")
    )
    rows = _real(desk).join(said, "client").join(facts, "client", "left").fillna(0, ["closed_requests", "rejected_requests"])
    return rows.select(
        "group_name", F.col("client").alias("user_name"), "closed_requests", "rejected_requests", "total_messages"
    ).orderBy("group_name", "user_name")


def _desk_tickets(desk: Desk, account: str, scope: Scope) -> DataFrame:
    """A desk's tickets, once for each real group of the client; none if the desk may not be reported on."""
    return desk.ticket.where((F.col("account") == account) & F.lit(scope.may_report(account))).join(_real(desk), "client")


def help_sla(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    return _spread(
        _desk_tickets(desk, account, scope).where(p.holds(F.col("opened_at")) & (F.col("frt_seconds") <= MAX_FRT)),
        "group_name", "frt_seconds", "responses"
    )


def help_resolution(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    rows = _desk_tickets(desk, account, scope).where(
        p.holds(F.col("closed_at")) & (F.col("status") == "closed") & (F.col("resolution_seconds") <= MAX_RESOLUTION)
    )
    return _spread(rows, "group_name", "resolution_seconds", "resolved")


def help_reopens(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    return _reopen_parts(_desk_tickets(desk, account, scope), p, F.col("group_name"), F.col("group_name"), "group_name")


def help_timeseries(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    zero = F.lit(0)
    said = _of_desk(desk, p, account, scope).join(_real(desk), "client").select(
        "group_name", F.to_date("created_at").alias("bucket"), F.lit(1).alias("messages"), zero.alias("closed"),
        zero.alias("rejected")
    )
    ends = _desk_tickets(desk, account, scope).where(p.holds(F.col("closed_at")))
    ends = ends.select(
        "group_name", F.to_date("closed_at").alias("bucket"), zero.alias("messages"),
        (F.col("status") == "closed").cast("int").alias("closed"),
        (F.col("status") == "rejected").cast("int").alias("rejected")
    )
    return said.unionByName(ends).groupBy("group_name", "bucket").agg(
        *(total(x).alias(x) for x in ("messages", "closed", "rejected"))
    ).orderBy("group_name", "bucket")


def help_categories(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    return _desk_tickets(desk, account, scope).where(p.holds(F.col("opened_at"))).groupBy("group_name", "category").agg(F.count("*").alias("requests")).orderBy(
        "group_name", F.desc("requests"), "category"
    )


def help_report_summary(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    """One row for each group with messages: totals, and response times in minutes, resolution times in hours."""
    people = help_users(desk, p, account, scope).groupBy("group_name").agg(
        F.count("*").alias("users"), total("total_messages").alias("messages"),
        total("closed_requests").alias("closed"), total("rejected_requests").alias("rejected")
    )
    unit = lambda c, by, name: F.round(F.col(c) / by, 1).alias(name)
    frt = help_sla(desk, p, account, scope).select(
        "group_name", "responses", unit("avg_seconds", 60, "avg_frt_min"), unit("p50_seconds", 60, "p50_frt_min"),
        unit("p90_seconds", 60, "p90_frt_min")
    )
    res = help_resolution(desk, p, account, scope).select(
        "group_name", "resolved", unit("avg_seconds", 3600, "avg_res_h"), unit("p50_seconds", 3600, "p50_res_h"),
        unit("p90_seconds", 3600, "p90_res_h")
    )
    again = help_reopens(desk, p, account, scope).select("group_name", "probable", "confirmed")
    out = people
    for side in (frt, res, again):
        out = out.join(side, "group_name", "left")
    return out.fillna(0, ["responses", "resolved", "probable", "confirmed"]).orderBy("group_name")


def help_report_monthly(desk: Desk, p: Period, account: str, scope: Scope = Scope.all()) -> DataFrame:
    """The summary of each calendar month of the period, the first and the last maybe partial; groups without messages in a month have no row."""
    out = None
    for start, end in monthly_ranges(p.start.date(), (p.end - timedelta(days=1)).date()):
        month = Period(datetime.combine(start, datetime.min.time()), datetime.combine(end + timedelta(days=1), datetime.min.time()))
        part = help_report_summary(desk, month, account, scope).select(F.lit(start.strftime("%Y-%m")).alias("month"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def write_help_report(desk: Desk, p: Period, account: str, uri: str, scope: Scope = Scope.all()) -> list[str]:
    """A folder of sheets for each month: the summary, and for each group its users, days and topics as titled sections."""
    made = []
    for start, end in monthly_ranges(p.start.date(), (p.end - timedelta(days=1)).date()):
        month = Period(datetime.combine(start, datetime.min.time()), datetime.combine(end + timedelta(days=1), datetime.min.time()))
        summary = help_report_summary(desk, month, account, scope)
        groups = [r.group_name for r in summary.select("group_name").collect()]  # a sheet for each group
        if not groups:
            continue
        parts = {"Пользователи": help_users, "Динамика по дням": help_timeseries, "Категории обращений": help_categories}
        frames = {title: f(desk, month, account, scope) for title, f in parts.items()}
        sheets: dict = {"Сводка по группам": summary}
        for g in groups:
            sheets[g] = [(title, df.where(F.col("group_name") == g).drop("group_name")) for title, df in frames.items()]
        name = f"help_{account}_{start:%Y-%m}"
        write_sheets(sheets, f"{uri.rstrip('/')}/{name}")
        made.append(name)
    return made


def alerts(desk: Desk, weeks: int = 8, scope: Scope = Scope.all()) -> DataFrame:
    """The week before the last message against the weeks before it: message spikes and slower first responses by visible group."""
    if desk.horizon is None:
        return desk.spark.createDataFrame([], "type string, group_name string, current double, baseline double, ratio double")
    end = F.lit(desk.horizon) - F.expr("INTERVAL 1 SECOND")
    week = end - F.expr("INTERVAL 7 DAYS")
    first = week - F.expr(f"INTERVAL {7 * weeks} DAYS")
    listed = scope.group_rows(desk.member).where(real_group(F.col("grp"))).select("client", F.col("grp").alias("group_name"))
    said = desk.message.where(F.col("created_at") >= first).join(listed, "client").groupBy("group_name")
    said = said.agg(
        n(F.col("created_at") >= week).cast("double").alias("current"),
        (n(F.col("created_at") < week) / weeks).alias("baseline")
    )
    said = said.where(
        (F.col("current") >= SPIKE_MESSAGES) & (F.col("baseline") > 0) & (F.col("current") >= SPIKE_RATIO * F.col("baseline"))
    )
    now = F.col("opened_at") >= week
    slow = desk.ticket.where((F.col("opened_at") >= first) & (F.col("frt_seconds") <= MAX_FRT)).join(listed, "client").groupBy("group_name")
    slow = slow.agg(
        F.avg(F.when(now, F.col("frt_seconds"))).alias("current"),
        F.avg(F.when(~now, F.col("frt_seconds"))).alias("baseline"), n(now).alias("count")
    )
    slow = slow.where(
        (F.col("count") >= SLA_TICKETS) & (F.col("baseline") > 0) & (F.col("current") >= SLA_RATIO * F.col("baseline"))
    ).drop("count")
    both = said.withColumn("type", F.lit("message_spike")).unionByName(slow.withColumn("type", F.lit("sla_degradation")))
    return both.select(
        "type", "group_name", F.round("current", 6).alias("current"), F.round("baseline", 6).alias("baseline"),
        F.round(F.col("current") / F.col("baseline"), 1).alias("ratio")
    ).orderBy(F.desc("ratio"))


def sync_status(desk: Desk) -> DataFrame:
    said = desk.message.select(F.lit("messages").alias("what"), F.lit("all").alias("value"))
    by = desk.ticket.select(F.lit("status").alias("what"), F.col("status").alias("value")).union(
        desk.ticket.where("reopen_llm IS NOT NULL").select(F.lit("verdict"), "reopen_llm")
    )
    return said.union(by).groupBy("what", "value").agg(F.count("*").alias("rows"))
