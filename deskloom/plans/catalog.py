"""Every report as a query over a folder of tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scope import Scope
from ..sources.adapter import Desk, desk
from . import metrics as M
from .oracle import index as index_sql, over
from .orders import in_order, order_of

PERIOD = M.Period(datetime(2024, 1, 8), datetime(2024, 1, 22))
S, E = "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-22'"
X = f"(SELECT least({E}, h) FROM horizon)"
ALL, SOME = Scope.all(), Scope(accounts=("help",), groups=("org1", "org2"))
PROBABLE = "coalesce(reopen_score > 0 OR reopen_llm = 'same', false)"
CONFIRMED = "coalesce(reopen_score >= 2 OR reopen_llm = 'same', false)"
REAL = "SELECT client, grp FROM client_group WHERE lower(grp) NOT LIKE 'help%' AND lower(grp) <> 'all'"
NAMES = f"gn AS (SELECT client, string_agg(DISTINCT grp, ', ' ORDER BY grp) AS group_names FROM ({REAL}) GROUP BY client)"
OFF = "(isodow(created_at) >= 6 OR hour(created_at) < 8 OR hour(created_at) >= 18)"
MINE = "SELECT client FROM client_group WHERE grp IN ('org1', 'org2')"
SOME_MESSAGES = f"(author = 'help' OR recipient = 'help' OR client IN ({MINE}))"
SOME_TICKETS = f"(account = 'help' OR client IN ({MINE}))"


def n(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def total(c: str) -> str:
    return f"CAST(coalesce(sum({c}), 0) AS BIGINT)"


def q(c: str, p: float) -> str:
    return f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6)"


def between(t: str, end: str = E) -> str:
    return f"{t} >= {S} AND {t} < {end}"


def bucket(t: str, unit: str) -> str:
    return f"CAST(date_trunc('{unit}', {t}) AS DATE)"


def shifted(t: str) -> str:
    return f"({t} + to_days(CASE isodow({t}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END))"


def timeseries(unit: str, messages: str = "true", tickets: str = "true") -> str:
    u = "coalesce(closed_at, stale_at)"
    return f"""
SELECT bucket, {total("m")} AS messages, {total("c")} AS closed, {total("r")} AS rejected,
       CAST((SELECT count(*) FROM ticket WHERE opened_at < {S} AND {u} >= {S} AND {tickets}) + sum(sum(o) - sum(d)) OVER (ORDER
         BY bucket) AS BIGINT) AS backlog
FROM (SELECT {bucket("created_at", unit)} AS bucket, 1 AS m, 0 AS c, 0 AS r, 0 AS o, 0 AS d FROM message WHERE
  {between("created_at", X)} AND {messages}
      UNION ALL SELECT {bucket("closed_at", unit)}, 0, CAST(status = 'closed' AS INT), CAST(status = 'rejected' AS INT), 0, 0
        FROM ticket WHERE {between("closed_at", X)} AND {tickets}
      UNION ALL SELECT {bucket("opened_at", unit)}, 0, 0, 0, 1, 0 FROM ticket WHERE {between("opened_at", X)} AND {tickets}
      UNION ALL SELECT {bucket(u, unit)}, 0, 0, 0, 0, 1 FROM ticket WHERE {between(u, X)} AND {tickets}) GROUP BY bucket"""


def spread(by: str, c: str, count: str, rows: str) -> str:
    return f"SELECT {by}, count(*) AS {count}, round(avg({c}), 6) AS avg_seconds, {q(c, 0.5)} AS p50_seconds, {q(c, 0.9)} AS p90_seconds FROM ({rows}) GROUP BY ALL"


def sla(unit: str) -> str:
    t = shifted("opened_at")
    return spread(
        "bucket", "frt_seconds", "responses",
        f"SELECT {bucket(t, unit)} AS bucket, frt_seconds FROM ticket WHERE {between(t)} AND frt_seconds <= 36000"
    )


def resolution(unit: str) -> str:
    t = shifted("closed_at")
    return spread(
        "bucket", "resolution_seconds", "resolved",
        f"SELECT {bucket(t, unit)} AS bucket, resolution_seconds FROM ticket WHERE {between(t)} AND status = 'closed' AND resolution_seconds <= 180000"
    )


def reopens(closed: str, opened: str, name: str, rows: str) -> str:
    return f"""SELECT {name}, {total("c")} AS closed, {total("p")} AS probable, {total("f")} AS confirmed FROM (
SELECT {closed} AS {name}, 1 AS c, 0 AS p, 0 AS f FROM {rows} WHERE {between("closed_at")} AND status IN ('closed', 'rejected')
UNION ALL SELECT {opened}, 0, 1, CAST({CONFIRMED} AS INT) FROM {rows} WHERE {between("opened_at")} AND {PROBABLE}) GROUP BY ALL"""


def details(where: str, client: str = "true", rows: int | None = 45_000) -> str:
    """The list's rows, newest first; ``truncated`` if there were more. None: every row."""
    yes = lambda c, name: f"coalesce({c}, false) AS {name}"
    closed = "status = 'closed' AND resolution_seconds <="
    newest = "" if rows is None else f" ORDER BY opened_at DESC, id DESC LIMIT {rows + 1}"
    cut = "" if rows is None else f" ORDER BY opened_at DESC, id DESC LIMIT {rows}"
    return f"""
WITH {NAMES}, b AS (SELECT *, status = 'open' AND stale_at >= {X} AS still_open FROM ticket WHERE {where} AND {client}{newest})
SELECT client, group_names, opened_at, last_activity, closed_at, CASE WHEN still_open THEN 'open' WHEN status IN ('expired',
  'open') THEN 'expired' ELSE status END AS status,
       category, messages_in, messages_out,
       first_responder, frt_seconds, closed_by, resolution_seconds, first_response_at IS NULL AS no_reply, awaiting_since IS NOT
         NULL AS awaiting, thanked AND status = 'closed' AS thanked,
       EXISTS (SELECT 1 FROM ticket r WHERE r.reopened_from = b.id AND coalesce(r.reopen_score > 0 OR r.reopen_llm = 'same',
         false)) AS reopened,
       {yes("frt_seconds <= 36000", "answered")}, {yes("frt_seconds <= 900", "answered_fast")},
         {yes("frt_seconds <= 3600", "answered_hour")},
       {yes(closed + " 180000", "resolved")}, {yes(closed + " 3600", "resolved_hour")}, {yes(closed + " 36000", "resolved_day")},
       {"false" if rows is None else f"(SELECT count(*) > {rows} FROM b)"} AS truncated
FROM b LEFT JOIN gn USING (client){cut}"""


def backlog_list(rows: int | None = 1000) -> str:
    newest = "" if rows is None else f"ORDER BY opened_at DESC, id DESC LIMIT {rows}"
    return f"""WITH {NAMES} SELECT client, group_names, opened_at, CAST(date_diff('day', opened_at, {X}) AS INTEGER) AS age_days,
      last_activity, category, messages_in, messages_out, first_responder,
  status AS final_status, closed_at FROM ticket LEFT JOIN gn USING (client) WHERE opened_at < {X} AND coalesce(closed_at,
    stale_at) >= {X} {newest}"""


def _facts(key: str, rows: str) -> str:
    return f"""msg AS (SELECT client, count(*) AS total FROM message WHERE {between("created_at")} GROUP BY client),
tk AS (SELECT client, {n(f"status = 'closed' AND {between('closed_at')}")} AS closed,
  {n(f"status = 'rejected' AND {between('closed_at')}")} AS rejected,
              {n(f"opened_at < {X} AND coalesce(closed_at, stale_at) >= {X}")} AS open_at_end FROM ticket GROUP BY client)"""


DESK_TICKETS = f"(SELECT t.*, cg.grp AS group_name FROM ticket t JOIN ({REAL}) cg USING (client) WHERE account = 'help')"
DESK_MESSAGES = f"{between('created_at')} AND ((direction = 'out' AND author = 'help') OR (direction = 'in' AND recipient = 'help'))"
HELP_USERS = f"""SELECT cg.grp AS group_name, client AS user_name, coalesce(closed, 0) AS closed_requests, coalesce(rejected, 0)
  AS rejected_requests, total AS total_messages
FROM ({REAL}) cg JOIN (SELECT client, count(*) AS total FROM message WHERE {DESK_MESSAGES} GROUP BY client) USING (client)
LEFT JOIN (SELECT client, {n(f"status = 'closed' AND {between('closed_at')}")} AS closed,
  {n(f"status = 'rejected' AND {between('closed_at')}")} AS rejected FROM ticket WHERE account = 'help' GROUP BY client) USING (client)"""
HELP_SLA = spread(
    "group_name", "frt_seconds", "responses",
    f"SELECT * FROM {DESK_TICKETS} WHERE {between('opened_at')} AND frt_seconds <= 36000"
)
HELP_RESOLUTION = spread(
    "group_name", "resolution_seconds", "resolved",
    f"SELECT * FROM {DESK_TICKETS} WHERE {between('closed_at')} AND status = 'closed' AND resolution_seconds <= 180000"
)
HELP_REOPENS = reopens("group_name", "group_name", "group_name", DESK_TICKETS)

SUMMARY = f"""
WITH b AS (SELECT *, status = 'open' AND stale_at >= {X} AS o, messages_in + messages_out AS msgs, NOT EXISTS (SELECT 1 FROM
  ticket p WHERE p.client = t.client AND p.opened_at < {S}) AS fresh,
           (SELECT count(DISTINCT author) FROM message m WHERE m.client = t.client AND m.direction = 'out' AND m.created_at >=
             t.opened_at AND m.created_at <= coalesce(t.closed_at, t.last_activity)) AS authors
           FROM ticket t WHERE {between("opened_at")})
SELECT * FROM (SELECT count(*) AS opened, {n("status = 'closed'")} AS closed, {n("status = 'rejected'")} AS rejected,
  {n("status IN ('expired', 'open') AND NOT o")} AS expired, {n("o")} AS still_open,
  {n("first_response_at IS NULL AND NOT o")} AS unanswered, {n("frt_seconds <= 36000")} AS answered, {n("frt_seconds <= 900")} AS
    answered_fast, {n("frt_seconds <= 3600")} AS answered_hour,
  {n("status = 'closed' AND resolution_seconds <= 180000")} AS resolved, {n("status = 'closed' AND resolution_seconds <= 3600")}
    AS resolved_hour, {n("status = 'closed' AND resolution_seconds <= 36000")} AS resolved_day,
  {n("in_progress_at IS NOT NULL")} AS in_progress, round(avg(pickup_seconds), 6) AS avg_pickup_seconds,
    {n("thanked AND status = 'closed'")} AS thanked, {total("replies")} AS replies, {total("reply_seconds")} AS reply_seconds,
  round(avg(msgs), 6) AS avg_messages, {q("msgs", 0.5)} AS p50_messages, {q("msgs", 0.9)} AS p90_messages, {n("authors > 1")} AS
    handoffs, count(DISTINCT client) AS clients, count(DISTINCT CASE WHEN fresh THEN client END) AS new_clients FROM b)
CROSS JOIN (SELECT count(*) AS incoming, {n(OFF)} AS off_hours FROM message WHERE direction = 'in' AND {between("created_at")})"""

OPERATORS = f"""
WITH st AS (SELECT author AS operator, count(*) AS messages, count(DISTINCT client) AS clients FROM message WHERE direction =
  'out' AND {between("created_at")} GROUP BY author),
en AS (SELECT closed_by AS operator, {n("status = 'closed'")} AS closed, {n("status = 'rejected'")} AS rejected,
  {n("thanked AND status = 'closed'")} AS thanked, {n("again")} AS reopened
       FROM (SELECT *, EXISTS (SELECT 1 FROM ticket r WHERE r.reopened_from = t.id AND coalesce(r.reopen_score > 0 OR
         r.reopen_llm = 'same', false)) AS again FROM ticket t WHERE {between("closed_at")}) GROUP BY closed_by),
fr AS (SELECT first_responder AS operator, round(avg(frt_seconds), 6) AS avg_reply_seconds FROM ticket WHERE
  {between("opened_at")} AND frt_seconds <= 36000 GROUP BY 1)
SELECT operator, messages, coalesce(closed, 0) AS closed, coalesce(rejected, 0) AS rejected, coalesce(reopened, 0) AS reopened,
  coalesce(thanked, 0) AS thanked, clients, avg_reply_seconds
FROM st LEFT JOIN en USING (operator) LEFT JOIN fr USING (operator)"""


CLIENTS = f"""
WITH {NAMES} SELECT client, any_value(group_names) AS group_names, count(*) AS tickets, {total("messages_in + messages_out")} AS
  messages, {n(PROBABLE)} AS reopens,
  NOT EXISTS (SELECT 1 FROM ticket p WHERE p.client = t.client AND p.opened_at < {S}) AS new_client
FROM ticket t LEFT JOIN gn USING (client) WHERE {between("opened_at")} GROUP BY client ORDER BY tickets DESC, messages DESC,
  client LIMIT 20"""
HELP_SUMS = f"""SELECT group_name, count(*) AS users, {total("total_messages")} AS messages, {total("closed_requests")} AS
  closed, {total("rejected_requests")} AS rejected
FROM ({HELP_USERS}) GROUP BY group_name"""
SLOW = """SELECT * EXCLUDE (frt_seconds), CASE WHEN client IN (SELECT client FROM client_group WHERE grp IN ('org1', 'org4')) AND
  opened_at < TIMESTAMP '2024-01-22' THEN frt_seconds // 10
  ELSE frt_seconds END AS frt_seconds FROM ticket"""


def slowed(d: Desk) -> Desk:
    """Desk tables in which two organisations had quicker answers before the last days, so that the alert has something to find."""
    late = d.member.where(F.col("grp").isin("org1", "org4")).select("client", F.lit(True).alias("late")).distinct()
    quick = F.col("late") & (F.col("opened_at") < F.lit(datetime(2024, 1, 22)))
    frt = F.when(quick, F.floor(F.col("frt_seconds") / 10)).otherwise(F.col("frt_seconds"))
    return replace(d, ticket=d.ticket.join(late, "client", "left").withColumn("frt_seconds", frt).select(d.ticket.columns))


def alerts(weeks: int, spike: bool = True, slow: bool = True) -> str:
    week, first = "(h - INTERVAL 1 SECOND - INTERVAL 7 DAYS)", f"(h - INTERVAL 1 SECOND - INTERVAL {7 + 7 * weeks} DAYS)"
    a = f"""SELECT 'message_spike' AS type, grp AS group_name, CAST({n(f"created_at >= {week}")} AS DOUBLE) AS cur,
      {n(f"created_at < {week}")} / {weeks}.0 AS base
FROM message JOIN ({REAL}) USING (client), horizon WHERE created_at >= {first} GROUP BY grp HAVING cur >= 30 AND base > 0 AND cur
  >= 2 * base"""
    b = f"""SELECT 'sla_degradation', grp, avg(frt_seconds) FILTER (WHERE opened_at >= {week}) AS cur, avg(frt_seconds) FILTER
      (WHERE opened_at < {week}) AS base
FROM ticket JOIN ({REAL}) USING (client), horizon WHERE opened_at >= {first} AND frt_seconds <= 36000 GROUP BY grp HAVING
  {n(f"opened_at >= {week}")} >= 10 AND base > 0 AND cur >= 2 * base"""
    return f"SELECT type, group_name, round(cur, 6) AS \"current\", round(CAST(base AS DOUBLE), 6) AS baseline, round(cur / base, 1) AS ratio FROM ({' UNION ALL '.join([a] * spike + [b] * slow)})"


def _query(name: str, make: Callable[[Desk], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: in_order(make(desk(spark, sf_dir)), order_of(name))


REPORTS: dict[str, tuple[Callable[[Desk], DataFrame], str, bool]] = {
    "message": (lambda d: d.message, "SELECT * FROM message", False),
    "ticket": (lambda d: d.ticket.drop("desk_authors"), "SELECT * FROM ticket", True),
    "corr_handoff": (
        lambda d: d.ticket.select("id", F.col("desk_authors").cast("long").alias("desk_authors")),
        """SELECT t.id, count(DISTINCT m.author) AS desk_authors FROM ticket t LEFT JOIN message m ON m.client = t.client AND m.direction = 'out'
        AND m.created_at >= t.opened_at AND m.created_at <= coalesce(t.closed_at, t.last_activity) GROUP BY t.id""",
        True,
    ),
    "client_group": (lambda d: d.member, "SELECT * FROM client_group", False),
    **{f"q_timeseries{'' if u == 'day' else '_' + u}": (lambda d, u=u: M.timeseries(d, PERIOD, ALL, u), timeseries(u), True) for u in ("day", "week", "month")},
    "q_timeseries_scoped": (lambda d: M.timeseries(d, PERIOD, SOME), timeseries("day", SOME_MESSAGES, SOME_TICKETS), True),
    "scope_deny_all": (
        lambda d: M.heatmap(d, PERIOD, Scope()),
        "SELECT 0 AS weekday, 0 AS hour, CAST(0 AS BIGINT) AS messages WHERE false", False
    ),
    "q_backlog": (
        lambda d: M.backlog(d, PERIOD, ALL),
        f"""SELECT (SELECT least({E}, h - INTERVAL 1 SECOND) FROM horizon) AS as_of, count(*) AS open_tickets, {n("a <= 1")} AS
          age_day, {n("a BETWEEN 2 AND 3")} AS age_three_days, {n("a BETWEEN 4 AND 7")} AS age_week,
        {n("a BETWEEN 8 AND 30")} AS age_month, {n("a > 30")} AS age_older, min(opened_at) AS oldest_opened_at FROM (SELECT *,
          date_diff('day', opened_at, {X}) AS a FROM ticket WHERE opened_at < {X} AND coalesce(closed_at, stale_at) >= {X})""",
        True,
    ),
    "q_backlog_tickets": (lambda d: M.backlog_tickets(d, PERIOD, ALL), backlog_list(), True),
    "q_heatmap": (
        lambda d: M.heatmap(d, PERIOD, ALL),
        f"SELECT CAST(isodow(created_at) - 1 AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS messages FROM message WHERE {between('created_at')} GROUP BY ALL",
        False
    ),
    "q_heatmap_scoped": (
        lambda d: M.heatmap(d, PERIOD, SOME),
        f"SELECT CAST(isodow(created_at) - 1 AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS messages FROM message WHERE {between('created_at')} AND {SOME_MESSAGES} GROUP BY ALL",
        False
    ),
    **{f"q_sla{'' if u == 'day' else '_' + u}": (lambda d, u=u: M.sla(d, PERIOD, ALL, u), sla(u), True) for u in ("day", "week", "month")},
    **{f"q_resolution{'' if u == 'day' else '_' + u}": (lambda d, u=u: M.resolution(d, PERIOD, ALL, u), resolution(u), True) for u in ("day", "week", "month")},
    **{
        f"q_reopens{'' if u == 'day' else '_' + u}": (
            lambda d, u=u: M.reopens(d, PERIOD, ALL, u),
            reopens(bucket("closed_at", u), bucket("opened_at", u), "bucket", "ticket"), True
        )
        for u in ("day", "week", "month")
    },
    "q_sla_scoped": (
        lambda d: M.sla(d, PERIOD, SOME),
        sla("day").replace("FROM ticket WHERE", f"FROM ticket WHERE {SOME_TICKETS} AND"), True
    ),
    "q_help_sla_denied": (lambda d: M.help_sla(d, PERIOD, "help-mag", SOME), f"SELECT * FROM ({HELP_SLA}) WHERE false", True),
    "q_help_accounts_scoped": (lambda d: M.help_accounts(d, SOME), "SELECT 'help' AS account", False),
    "q_alerts": (lambda d: M.alerts(d), alerts(8), True),
    "q_alerts_spike": (lambda d: M.alerts(d).where("type = 'message_spike'"), alerts(8, slow=False), True),
    "q_alerts_sla": (
        lambda d: M.alerts(slowed(d)).where("type = 'sla_degradation'"),
        f"WITH slower AS ({SLOW}) " + alerts(8).replace("FROM ticket JOIN", "FROM slower JOIN") + " WHERE type = 'sla_degradation'",
        True,
    ),
    "q_alerts_scoped": (
        lambda d: M.alerts(slowed(d), scope=Scope(groups=("Org1", "ORG2"))),
        f"WITH slower AS ({SLOW}) SELECT * FROM (" + alerts(8).replace(
            "FROM ticket JOIN", "FROM slower JOIN"
        ) + ") WHERE group_name IN ('org1', 'org2')",
        True,
    ),
    "q_categories": (
        lambda d: M.categories(d, PERIOD, ALL),
        f"""SELECT category, count(*) AS requests, {q("CASE WHEN frt_seconds <= 36000 THEN frt_seconds END", 0.5)} AS p50_frt_seconds,
        {q("CASE WHEN status = 'closed' AND resolution_seconds <= 180000 THEN resolution_seconds END", 0.5)} AS
          p50_resolution_seconds, round(avg(messages_in + messages_out), 6) AS avg_messages, {n(PROBABLE)} AS reopens,
        {n(f"first_response_at IS NULL AND NOT (status = 'open' AND stale_at >= {X})")} AS unanswered FROM ticket WHERE
          {between("opened_at")} GROUP BY category""",
        True,
    ),
    "q_category_timeseries": (
        lambda d: M.category_timeseries(d, PERIOD, ALL),
        f"SELECT {bucket('opened_at', 'day')} AS bucket, category, count(*) AS requests FROM ticket WHERE {between('opened_at')} GROUP BY ALL",
        True
    ),
    "q_summary": (lambda d: M.summary(d, PERIOD, ALL), SUMMARY, True),
    "q_tickets_opened": (lambda d: M.ticket_details(d, PERIOD, ALL), details(between("opened_at")), True),
    "q_tickets_closed": (lambda d: M.ticket_details(d, PERIOD, ALL, "closed"), details(between("closed_at", X)), True),
    "q_tickets_of_client": (lambda d: M.ticket_details(d, PERIOD, ALL, client="u7"), details(between("opened_at"), "client = 'u7'"), True),
    "q_client_messages": (
        lambda d: M.client_messages(d, PERIOD, ALL),
        f"""WITH {NAMES} SELECT client, any_value(group_names) AS group_names, {n("direction = 'in'")} AS messages_in,
          {n("direction = 'out'")} AS messages_out, {n(f"direction = 'in' AND isodow(created_at) < 6 AND {OFF}")} AS off_hours_night,
        {n("direction = 'in' AND isodow(created_at) >= 6")} AS off_hours_weekend FROM message LEFT JOIN gn USING (client) WHERE
          {between("created_at", X)} GROUP BY client""",
        False,
    ),
    "q_off_hours_messages": (
        lambda d: M.off_hours_messages(d, PERIOD, ALL),
        f"WITH {NAMES} SELECT client, group_names, created_at AS at FROM message LEFT JOIN gn USING (client) WHERE direction = 'in' AND {between('created_at', X)} AND {OFF}",
        False
    ),
    "q_clients": (lambda d: M.clients(d, PERIOD, ALL), CLIENTS, True),
    "q_operators": (lambda d: M.operators(d, PERIOD, ALL), OPERATORS, True),
    "q_groups": (lambda d: M.groups(d, ALL), f"SELECT DISTINCT grp AS group_name FROM ({REAL})", False),
    "q_groups_scoped": (
        lambda d: M.groups(d, SOME), f"SELECT DISTINCT grp AS group_name FROM ({REAL}) WHERE grp IN ('org1', 'org2')",
        False
    ),
    "q_companies": (
        lambda d: M.companies(d, PERIOD, ALL),
        f"""WITH {_facts("", "")} SELECT grp AS group_name, count(DISTINCT CASE WHEN total IS NOT NULL THEN client END) AS
          active_users, count(DISTINCT client) AS total_users, {total("closed")} AS closed_requests,
        {total("rejected")} AS rejected_requests, {total("open_at_end")} AS open_requests, {total("total")} AS total_messages
          FROM ({REAL}) LEFT JOIN msg USING (client) LEFT JOIN tk USING (client) GROUP BY grp HAVING sum(total) > 0""",
        True,
    ),
    "q_users": (
        lambda d: M.users(d, PERIOD, ALL, "org3"),
        f"""WITH {_facts("", "")} SELECT client AS user_name, last_seen_at, coalesce(closed, 0) AS closed_requests,
          coalesce(rejected, 0) AS rejected_requests, coalesce(open_at_end, 0) AS open_requests, coalesce(total, 0) AS total_messages
        FROM client_group LEFT JOIN msg USING (client) LEFT JOIN tk USING (client) WHERE grp = 'org3'""",
        True,
    ),
    "q_chat": (
        lambda d: M.chat(d, PERIOD, ALL, "u7"),
        f"SELECT client, author AS sender, recipient, direction, txt AS message, created_at FROM message WHERE {between('created_at')} AND client = 'u7'",
        False
    ),
    "q_chat_participants": (
        lambda d: M.chat_participants(d, PERIOD, ALL),
        f"""SELECT client, created_at AS last_at, c AS messages, left(txt, 140) AS last_text, direction AS last_direction FROM
          (SELECT *, count(*) OVER (PARTITION BY client) AS c,
        row_number() OVER (PARTITION BY client ORDER BY created_at DESC, source_id DESC) AS rn FROM message WHERE
          {between("created_at")}) WHERE rn = 1""",
        False,
    ),
    "q_chat_tickets": (
        lambda d: M.chat_tickets(d, PERIOD, ALL, "u7"),
        f"""SELECT opened_at, in_progress_at, closed_at, last_activity, status, category, frt_seconds, resolution_seconds,
          closed_by, {PROBABLE} AS reopen, thanked
        FROM ticket WHERE client = 'u7' AND opened_at < {E} AND coalesce(closed_at, last_activity) >= {S}""",
        True,
    ),
    "q_help_accounts": (
        lambda d: M.help_accounts(d),
        "SELECT author AS account FROM message WHERE direction = 'out' UNION SELECT recipient FROM message WHERE direction = 'in'",
        False
    ),
    "q_help_users": (lambda d: M.help_users(d, PERIOD, "help"), HELP_USERS, True),
    "q_help_sla": (lambda d: M.help_sla(d, PERIOD, "help"), HELP_SLA, True),
    "q_help_resolution": (lambda d: M.help_resolution(d, PERIOD, "help"), HELP_RESOLUTION, True),
    "q_help_reopens": (lambda d: M.help_reopens(d, PERIOD, "help"), HELP_REOPENS, True),
    "q_help_timeseries": (
        lambda d: M.help_timeseries(d, PERIOD, "help"),
        f"""SELECT group_name, bucket, {total("m")} AS messages, {total("c")} AS closed, {total("r")} AS rejected FROM (
        SELECT grp AS group_name, CAST(created_at AS DATE) AS bucket, 1 AS m, 0 AS c, 0 AS r FROM message JOIN ({REAL}) USING
          (client) WHERE {DESK_MESSAGES}
        UNION ALL SELECT group_name, CAST(closed_at AS DATE), 0, CAST(status = 'closed' AS INT), CAST(status = 'rejected' AS INT)
          FROM {DESK_TICKETS} WHERE {between("closed_at")}) GROUP BY ALL""",
        True,
    ),
    "q_help_categories": (
        lambda d: M.help_categories(d, PERIOD, "help"),
        f"SELECT group_name, category, count(*) AS requests FROM {DESK_TICKETS} WHERE {between('opened_at')} GROUP BY ALL",
        True
    ),
    "q_help_report_summary": (
        lambda d: M.help_report_summary(d, PERIOD, "help"),
        f"""WITH u AS (SELECT group_name, count(*) AS users, {total("total_messages")} AS messages, {total("closed_requests")} AS
          closed, {total("rejected_requests")} AS rejected FROM ({HELP_USERS}) GROUP BY 1),
        s AS (SELECT group_name, responses, round(avg_seconds / 60, 1) AS avg_frt_min, round(p50_seconds / 60, 1) AS p50_frt_min,
          round(p90_seconds / 60, 1) AS p90_frt_min FROM ({HELP_SLA})),
        r AS (SELECT group_name, resolved, round(avg_seconds / 3600, 1) AS avg_res_h, round(p50_seconds / 3600, 1) AS p50_res_h,
          round(p90_seconds / 3600, 1) AS p90_res_h FROM ({HELP_RESOLUTION})),
        o AS (SELECT group_name, probable, confirmed FROM ({HELP_REOPENS}))
        SELECT group_name, users, messages, closed, rejected, coalesce(responses, 0) AS responses, avg_frt_min, p50_frt_min,
          p90_frt_min, coalesce(resolved, 0) AS resolved, avg_res_h, p50_res_h, p90_res_h,
        coalesce(probable, 0) AS probable, coalesce(confirmed, 0) AS confirmed FROM u LEFT JOIN s USING (group_name) LEFT JOIN r
          USING (group_name) LEFT JOIN o USING (group_name)""",
        True,
    ),
    "q_sync_status": (
        lambda d: M.sync_status(d),
        "SELECT 'messages' AS what, 'all' AS value, count(*) AS rows FROM message UNION ALL SELECT 'status', status, count(*) FROM ticket GROUP BY status UNION ALL SELECT 'verdict', reopen_llm, count(*) FROM ticket WHERE reopen_llm IS NOT NULL GROUP BY reopen_llm",
        True,
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, make) for name, (make, _, _) in REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: over(sql, tickets) for name, (_, sql, tickets) in REPORTS.items()}
