"""Drill-downs, dashboard figures, event windows and ingest as queries, with their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import working_time as W
from ..operators import events, scope, verdicts
from ..operators.scope import Scope
from ..sources import archive, embedded
from ..sources.store import Store, monthly_ranges, scratch_folder, write_json, write_sheets
from ..streaming import ingest
from ..streaming.served import Served
from . import catalog as C, dashboard as D, drill, metrics as M

P, ALL = C.PERIOD, C.ALL


def _sql_histogram(c: str, *bounds: tuple[int | None, str]) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(
        f"WHEN {c} <= {most} THEN '{label}'" for most, label in bounds[:-1]
    ) + f" ELSE '{bounds[-1][1]}' END"


# labels and bounds of the SQL, written out here so that a wrong one in the cards shows
NO_GROUP = "Без организации"
ARRIVAL = """CASE WHEN isodow(opened_at) >= 6 THEN 'выходные' WHEN hour(opened_at) < 8 OR hour(opened_at) >= 18 THEN 'будни, вечер и ночь' ELSE 'рабочее время' END"""
SILENT = """CASE WHEN status = 'expired' THEN CASE WHEN no_reply THEN 'поддержка, ни разу' WHEN awaiting THEN 'поддержка, на последнее' ELSE 'клиент' END END"""
FIRST = "coalesce(first_responder, 'никто')"
OUTCOME = "CASE final_status WHEN 'open' THEN 'так и не закрыта' WHEN 'closed' THEN 'закрыта позже' WHEN 'rejected' THEN 'отклонена позже' WHEN 'expired' THEN 'истекла позже' END"
AGE = _sql_histogram("age_days", (1, "до 1 дня"), (3, "2-3 дня"), (7, "4-7 дней"), (30, "8-30 дней"), (None, "больше месяца"))
FRT = _sql_histogram("frt_seconds", (300, "до 5 мин"), (900, "5-15 мин"), (3600, "15-60 мин"), (14400, "1-4 ч"), (None, "больше 4 ч"))
RES = _sql_histogram(
    "resolution_seconds", (3600, "до 1 ч"), (14400, "1-4 ч"), (36000, "4 ч - 1 раб. день"), (180000, "1-5 раб. дней"),
    (None, "больше 5 раб. дней")
)
OPENED, CLOSED = C.details(C.between("opened_at"), rows=None), C.details(C.between("closed_at", C.X), rows=None)
MESSAGES, BACKLOG = C.REPORTS["q_client_messages"][1], C.backlog_list(None)
def _n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"CASE WHEN {whole} > 0 THEN floor(100.0 * {part} / {whole} + 0.5) END"


QUIET, MUTE = "status = 'expired' AND NOT no_reply AND NOT awaiting", "status = 'expired' AND (no_reply OR awaiting)"
CARDS = {
    "messages": (MESSAGES, "true", "messages_in + messages_out", None, {}),
    "offHours": (MESSAGES, "true", "off_hours_night + off_hours_weekend", "messages_in", {}),
    "closed": (CLOSED, "status = 'closed'", "1", None, {"closed_by": "closed_by", "resolution": RES, "category": "category"}),
    "rejected": (CLOSED, "status = 'rejected'", "1", None, {"closed_by": "closed_by", "category": "category"}),
    "open": (BACKLOG, "true", "1", None, {"age": AGE, "category": "category", "first": FIRST, "outcome": OUTCOME}),
    "unanswered": (OPENED, "true", "CAST(no_reply AS INT)", "CAST(status <> 'open' AS INT)", {"arrival": ARRIVAL, "category": "category"}),
    "expired": (OPENED, "true", "CAST(status = 'expired' AS INT)", "1", {"silent": SILENT, "first": FIRST, "category": "category"}),
    "fast": (OPENED, "true", "CAST(answered_fast AS INT)", "CAST(answered AS INT)", {"frt": FRT, "first": FIRST}),
    "resolved": (OPENED, "true", "CAST(resolved_hour AS INT)", "CAST(resolved AS INT)", {"resolution": RES, "closed_by": "closed_by"}),
    "thanked": (
        OPENED, "true", "CAST(thanked AS INT)", "CAST(status = 'closed' AS INT)",
        {"closed_by": "closed_by", "category": "category"}
    ),
}


def _tally(rows: str, where: str, count: str, base: str | None, breakdowns: dict[str, str]) -> str:
    lines = {"organisation": f"coalesce(group_names, '{NO_GROUP}')", **breakdowns}
    parts = " UNION ALL ".join(
        f"SELECT '{k}' AS breakdown, {label} AS label, {count} AS c, {base or '0'} AS b FROM d WHERE {where}" for k,
        label in lines.items()
    )
    return f"SELECT breakdown, label, {C.total('c')} AS count, {C.total('b')} AS base FROM (WITH d AS ({rows}) {parts}) WHERE label IS NOT NULL AND {'b > 0' if base else 'true'} GROUP BY ALL"


def _card(key: str):
    return lambda d: drill.tally(drill.cards()[key], d, P, ALL)


OFF = f"SELECT client, created_at AS t FROM message WHERE direction = 'in' AND {C.between('created_at', C.X)} AND {C.OFF}"
TIMES = C.timeseries("day")
SLA, REOPENS = C.sla("day"), C.REPORTS["q_reopens"][1]
TREND = C.REPORTS["q_category_timeseries"][1]
KEY = r"list_aggregate(list_transform(regexp_extract_all(client, '(\d+|\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE lower(x) END), 'string_agg', '')"
MINUTES = "floor((epoch(created_at) - epoch(lag(created_at) OVER w)) / 60)"

ARCHIVE = """SELECT source_id * 4 AS id, author AS username, txt FROM message WHERE source_id % 17 <> 0 UNION ALL SELECT
  source_id * 4 + 1, recipient, txt FROM message
  UNION ALL SELECT source_id * 4 + 2, author, '  ' FROM message WHERE source_id % 13 = 0 UNION ALL SELECT source_id * 4 + 3,
    'u1', 'между собой' FROM message WHERE source_id % 19 = 0"""


def _rosters(d):
    """The users and groups of a chat server whose desks serve the groups they have here."""
    served = d.desk_groups.groupBy("account").agg(F.sort_array(F.collect_list("grp")).alias("groups"))
    users = served.select(F.concat("account", F.lit("@desk")).alias("jid"), F.concat(F.lit("help-of-"), "account").alias("grp"))
    names = F.array_join(F.transform("groups", lambda g: F.concat(F.lit('<<"'), g, F.lit('">>'))), ",")
    term = F.concat(F.lit('[{name,<<"desk">>},{displayed_groups,[<<"all">>,<<"help-x">>,'), names, F.lit("]}]"))
    return users, served.select(F.concat(F.lit("HELP-of-"), "account").alias("name"), term.alias("opts"))


def _by_month(d):
    """The months from the first message to the last, whose ends may be partial, with their messages, each moved by up to 149 days to fill several months."""
    moved = d.message.select((F.col("created_at") + F.make_dt_interval(F.col("source_id").cast("int") % 150)).alias("created_at"))
    lo, hi = moved.agg(F.min("created_at"), F.max("created_at")).first()
    ranges = monthly_ranges(lo.date(), hi.date()) if lo else []
    months = d.spark.createDataFrame(ranges, "first date, last date").withColumn("month", F.trunc("first", "month"))
    counts = moved.groupBy(F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias("messages"))
    return months.join(counts, "month").select("first", "last", "messages")


KEPT = "id, client, account, opened_at, closed_at, first_response_at, frt_seconds, status, category, messages_in, messages_out, thanked"


def _as_json(d):
    """Tickets written as lines of JSON and read back."""
    rows, uri = d.ticket.selectExpr(*KEPT.split(", ")), scratch_folder(d.spark, "json")
    write_json(rows, uri)
    return d.spark.read.schema(rows.schema).json(uri)


def _as_sheets(d):
    """A sheet with two sections, counts of tickets and of messages, written as CSV and read back."""
    uri, wanted = scratch_folder(d.spark, "sheets"), {"tickets": (d.ticket, "status"), "messages": (d.message, "direction")}
    sections = [(title, df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))) for title, (df, c) in wanted.items()]
    (sheet,) = write_sheets({"How many?": sections}, uri)
    parts = [
        d.spark.read.schema("name string, n long").option("header", True).csv(f"{uri}/{sheet}/{i:02d} {title}").select(F.lit(title).alias("section"), "name", "n")
        for i, (title, _) in enumerate(sections, 1)
    ]
    return parts[0].unionByName(parts[1])


def _stored(d):
    """Tickets by client after two commits to a store of buckets, the second of which rewrites some of them."""
    spark = d.spark
    store = Store(spark, scratch_folder(spark, "store"), buckets=8)
    state = store.commit(store.state(), 0, replace={"ticket": d.ticket.withColumn("messages_in", F.col("messages_in") + 1)})
    state = store.commit(state, 1, rewrite={"ticket": (d.ticket.where(store.bucket(F.col("client")) < 4), range(4))})
    store.commit(state, 2, rewrite={"ticket": (d.ticket.where(store.bucket(F.col("client")) >= 4), range(4, 8))})
    return store.table("ticket").groupBy("client").agg(F.count("*").alias("tickets"), F.sum("messages_in").alias("messages_in"))


def _spelt(d):
    """A desk whose group names are spelt in three ways, brought to one spelling."""
    way = F.pmod(F.substring("client", 2, 9).cast("int"), F.lit(3))
    named = F.when(way == 0, F.upper("grp")).when(way == 1, F.regexp_replace("grp", "^o", "ö")).otherwise(F.col("grp"))
    return replace(d, member=scope.one_spelling(d.member.withColumn("grp", named)))


# the folded keys written out, and of each the least spelling
SPELT = """WITH w AS (SELECT client, CASE CAST(substr(client, 2) AS INTEGER) % 3 WHEN 0 THEN upper(grp) WHEN 1 THEN regexp_replace(grp, '^o', 'ö') ELSE grp END AS g FROM client_group),
k AS (SELECT replace(lower(g), 'ö', 'o') AS k, min(g) AS name FROM w GROUP BY ALL),
spelt AS (SELECT DISTINCT client, name AS grp FROM w JOIN k ON k.k = replace(lower(g), 'ö', 'o'))"""
_SERVED: dict[tuple[str, str], Served] = {}


def _served(d) -> Served:
    """A store that the desk's archive has gone into: most of it at once, the rest in two smaller batches; held for a session and folder."""
    key = (d.spark.sparkContext.applicationId, d.folder)
    if key not in _SERVED:
        _SERVED.clear()
        store = Store(d.spark, scratch_folder(d.spark, "served"))
        rows = archive.archived(d.message)
        top = rows.agg(F.max("id")).first()[0]
        for above, to in ((-1, top * 8 // 10), (top * 8 // 10, top * 9 // 10), (top * 9 // 10, top)):
            ingest.ingest(store, rows.where(f"id > {above} AND id <= {to}"), {"client_group": d.member.where(f"{to} = {top} OR client < 'u5'")})
        _SERVED[key] = Served(store)
    return _SERVED[key]


SHOWN = """client, account, opened_at, last_activity, stale_at, first_response_at, first_responder, frt_seconds, in_progress_at, pickup_seconds, closed_at, closed_by,
resolution_seconds, status, category, messages_in, messages_out, reopened_from IS NOT NULL AS linked, reopen_score, reopen_llm, thanked, awaiting_since, replies, reply_seconds, resumes"""


def _over_jdbc(d):
    """The archive in embedded databases, each read above an id in ranges of about as many rows."""
    rows = archive.archived(d.message).select("id", "username", "txt").where("id <= 8000 OR id > 20000")  # a gap in the ids
    urls = embedded.databases(rows, scratch_folder(d.spark, "databases"), "ID BIGINT, USERNAME VARCHAR(200), TXT VARCHAR(2000)")
    with ThreadPoolExecutor(4) as pool:  # each asks its database for the numbers of rows
        found = list(pool.map(lambda url: archive.archive_rows(d.spark, url, above=4000, tasks=4, driver=embedded.DRIVER), urls))
    read = reduce(DataFrame.unionAll, found) if found else d.spark.createDataFrame([], "ID long, USERNAME string, TXT string")
    return read.select(F.col("ID").alias("id"), F.col("USERNAME").alias("username"), F.col("TXT").alias("txt"))


FACTS = {
    "messages": {
        "total": "sum(messages_in + messages_out)", "from_clients": "sum(messages_in)", "from_clients_pct": _pct(
            "sum(messages_in)", "sum(messages_in + messages_out)"
        ), "from_support": "sum(messages_out)", "clients": "count(*)",
    },
    "offHours": {
        "off_hours": "sum(off_hours_night + off_hours_weekend)", "off_hours_pct": _pct(
            "sum(off_hours_night + off_hours_weekend)", "sum(messages_in)"
        ), "night": "sum(off_hours_night)", "weekend": "sum(off_hours_weekend)",
        "incoming": "sum(messages_in)",
    },
    "closed": {
        "closed": "count(*)", "median_resolution": "round(median(resolution_seconds) FILTER (WHERE resolved), 6)",
        "thanked": _n("thanked"), "thanked_pct": _pct(_n("thanked")), "reopened": _n("reopened"),
        "reopened_pct": _pct(_n("reopened")),
    },
    "rejected": {"rejected": "count(*)"},
    "open": {
        "open": "count(*)", "до 1 дня": _n("age_days <= 1"), "2-3 дня": _n("age_days BETWEEN 2 AND 3"),
        "4-7 дней": _n("age_days BETWEEN 4 AND 7"), "8-30 дней": _n("age_days BETWEEN 8 AND 30"),
        "больше месяца": _n("age_days > 30"),
        "oldest_day": "date_diff('day', DATE '1970-01-01', CAST(min(opened_at) AS DATE))",
    },
    "unanswered": {
        "unanswered": _n("no_reply"), "unanswered_pct": _pct(_n("no_reply")), "off_hours_pct": _pct(
            _n("no_reply AND (isodow(opened_at) >= 6 OR hour(opened_at) < 8 OR hour(opened_at) >= 18)"), _n("no_reply")
        ),
    },
    "expired": {
        "expired": _n("status = 'expired'"), "expired_pct": _pct(_n("status = 'expired'")), "support_silent": _n(MUTE), "support_silent_pct": _pct(
            _n(MUTE), _n("status = 'expired'")
        ),
        "client_silent": _n(QUIET), "client_silent_pct": _pct(_n(QUIET), _n("status = 'expired'")),
    },
    "fast": {
        "fast": _n("answered_fast"), "fast_pct": _pct(_n("answered_fast")), "hour": _n("answered_hour"),
        "hour_pct": _pct(_n("answered_hour")), "median_frt": "round(median(frt_seconds), 6)", "answered": "count(*)",
    },
    "resolved": {
        "hour": _n("resolved_hour"), "hour_pct": _pct(_n("resolved_hour")), "day": _n("resolved_day"),
        "day_pct": _pct(_n("resolved_day")), "median_resolution": "round(median(resolution_seconds), 6)",
        "resolved": "count(*)",
    },
    "thanked": {"thanked": _n("thanked"), "thanked_pct": _pct(_n("thanked")), "closed": "count(*)"},
}


def _fact_sql(key: str) -> str:
    rows, where, _, base, _ = CARDS[key]
    population = f"SELECT * FROM d WHERE {where} AND {f'{base} > 0' if base else 'true'}"
    parts = " UNION ALL ".join(f"SELECT '{name}' AS fact, CAST({value} AS DOUBLE) AS value FROM p" for name, value in FACTS[key].items())
    return f"SELECT fact, value FROM (WITH d AS ({rows}), p AS ({population}) {parts})"


def _facts(key: str):
    return lambda d: drill.facts(drill.cards()[key], d, P, ALL)


MOMENTS = {
    "closed": (CLOSED, "status = 'closed'", "closed_at"), "rejected": (CLOSED, "status = 'rejected'", "closed_at"), "unanswered": (
        OPENED, "no_reply AND status <> 'open'", "opened_at"
    ),
    "expired": (OPENED, "status = 'expired'", "last_activity"), "fast": (
        OPENED, "answered AND NOT answered_fast", "opened_at"
    ), "resolved": (OPENED, "resolved AND NOT resolved_hour", "opened_at"),
    "thanked": (OPENED, "status = 'closed' AND thanked", "coalesce(closed_at, opened_at)"),
}
EVENTS = " UNION ALL ".join(
    f"SELECT '{k}' AS card, client, group_names, {at} AS \"at\" FROM (SELECT * FROM ({rows})) WHERE {where}" for k,
    (rows, where, at) in MOMENTS.items()
)


def _events(d):
    return drill.every_event(d, P, ALL)


def _side(name: str, start: str, end: str) -> str:
    """The first three texts of a client within a span, at most 600 characters, as the rule for cutting has it."""
    return f"""{name}_t AS (SELECT l.id, m.txt, row_number() OVER (PARTITION BY l.id ORDER BY m.created_at, m.source_id) AS r
      FROM linked l JOIN message m
  ON m.client = l.client AND m.direction = 'in' AND m.created_at >= {start} AND {end}),
{name}_s AS (SELECT id, max(txt) FILTER (r = 1) AS a, max(txt) FILTER (r = 2) AS b, max(txt) FILTER (r = 3) AS c FROM {name}_t
  WHERE r <= 3 GROUP BY id),
{name}_2 AS (SELECT id, c, length(a) > 600 OR length(a) + length(b) > 600 AS full2, CASE WHEN length(a) > 600 THEN left(a, 600)
  WHEN b IS NULL THEN a
  WHEN length(a) + length(b) > 600 THEN a || left(b, 600 - length(a)) ELSE a || chr(10) || b END AS s FROM {name}_s),
{name} AS (SELECT id, CASE WHEN coalesce(full2, false) OR c IS NULL THEN s WHEN length(s) + length(c) > 600 THEN s || left(c,
  greatest(0, 600 - length(s))) ELSE s || chr(10) || c END AS text FROM {name}_2)"""


TEXTS = f"""WITH linked AS (SELECT t.id, t.client, t.opened_at, t.reopen_llm, p.opened_at AS s, coalesce(p.closed_at,
  p.last_activity) AS e FROM ticket t JOIN ticket p ON p.id = t.reopened_from),
{_side("bef", "l.s", "m.created_at <= l.e")},
{_side("aft", "l.opened_at", "true")},
texts AS (SELECT l.id, l.client, l.opened_at, l.reopen_llm = 'pending' IS TRUE AS pending, coalesce(bef.text,
  '(текст недоступен)') AS before, coalesce(aft.text, '(текст недоступен)') AS now
  FROM linked l LEFT JOIN bef USING (id) LEFT JOIN aft USING (id))"""
SAME = "CASE WHEN substr(before, 1, 2) = substr(now, 1, 2) THEN 'same' ELSE 'new' END"
JUDGED = f"""{TEXTS}, said AS (SELECT id, {SAME} AS verdict FROM texts WHERE pending),
judged AS (SELECT t.* EXCLUDE (reopen_llm), CASE WHEN reopen_llm = 'pending' THEN coalesce(verdict, reopen_llm) ELSE reopen_llm
  END AS reopen_llm FROM ticket t LEFT JOIN said USING (id))"""


def same_first_word(before: pd.Series, now: pd.Series) -> pd.Series:
    """A rule in a model's place: the same matter if both sides begin with the same two letters."""
    return (before.str[:2] == now.str[:2]).map({True: "SAME", False: "NEW"})


def _judged(d):
    return replace(d, ticket=verdicts.written_back(d.ticket, verdicts.judged(d.ticket, d.message, same_first_word, budget=None)))


GRANTS = """WITH gr AS (SELECT DISTINCT 'm' || (c_custkey % 40) AS usr, c_custkey % 4 = 0 AS desk,
    CASE WHEN c_custkey % 4 = 0 THEN ['help', 'help-mag', 'help-dnk'][CAST(c_custkey % 3 AS INTEGER) + 1] ELSE 'ORG' ||
      (c_nationkey % 7) END AS v, c_custkey % 5 <> 0 AS can_metrics, c_custkey % 3 <> 0 AS can_chats FROM customer),
  served(account, grp) AS (VALUES ('help', 'org0'), ('help', 'org1'), ('help', 'org2'), ('help-mag', 'org3'), ('help-mag',
    'org4'), ('help-dnk', 'org5'), ('help-dnk', 'org6')),
  g AS (SELECT DISTINCT usr, v AS account, s.grp FROM gr LEFT JOIN served s ON s.account = v WHERE desk AND can_metrics UNION
    SELECT usr, NULL, v FROM gr WHERE NOT desk AND can_metrics)"""

def _month(a: str, b: str) -> str:
    return C.REPORTS["q_help_report_summary"][1].replace(C.S, f"TIMESTAMP '{a}'").replace(C.E, f"TIMESTAMP '{b}'")


MONTHLY = f"SELECT '2024-01' AS month, * FROM ({_month('2024-01-08', '2024-02-01')}) UNION ALL SELECT '2024-02', * FROM ({_month('2024-02-01', '2024-02-11')})"

REPORTS = {
    **{f"q_drill_{k}": (_card(k), _tally(*card), True) for k, card in CARDS.items()},
    "q_bursts": (
        lambda d: events.bursts(M.off_hours_messages(d, P, ALL).select("client", "at").distinct()),
        f'SELECT client, t AS "at" FROM (SELECT *, lag(t) OVER (PARTITION BY client ORDER BY t) AS p FROM (SELECT DISTINCT * FROM ({OFF}))) WHERE p IS NULL OR floor((epoch(t) - epoch(p)) / 60) >= 30',
        False,
    ),
    "q_conversation_days": (
        lambda d: events.conversation_days(d.message.where(P.holds(F.col("created_at")))),
        f"SELECT client, CAST(created_at AS DATE) AS day, min(created_at) AS \"at\" FROM message WHERE {C.between('created_at')} GROUP BY ALL",
        False,
    ),
    "q_message_runs": (
        lambda d: events.message_runs(d.message).select("source_id", "continued"),
        f"SELECT source_id, coalesce(lag(direction) OVER w = direction AND lag(author) OVER w = author AND {MINUTES} < 5, false) AS continued FROM message WINDOW w AS (PARTITION BY client, CAST(created_at AS DATE) ORDER BY created_at, source_id)",
        False,
    ),
    "q_overall_frt": (
        lambda d: D.overall_frt(d, P, ALL),
        f"SELECT round(sum(avg_seconds * responses) / sum(responses), 4) AS mean_seconds, round(sum(p50_seconds * responses) / sum(responses), 4) AS typical_seconds FROM ({SLA})",
        True
    ),
    "q_totals": (
        lambda d: D.totals(d, P, ALL),
        f"SELECT {C.total('messages')} AS messages, {C.total('closed')} AS closed, {C.total('rejected')} AS rejected, CAST(round(avg(messages)) AS BIGINT) AS per_bucket FROM ({TIMES})",
        True
    ),
    "q_reopen_rate": (
        lambda d: D.reopen_rate(d, P, ALL),
        f"""SELECT c AS closed, p AS probable, f AS confirmed, CAST(floor(100.0 * p / c + 0.5) AS BIGINT) AS probable_pct,
          CAST(floor(100.0 * f / c + 0.5) AS BIGINT) AS confirmed_pct
        FROM (SELECT {C.total("closed")} AS c, {C.total("probable")} AS p, {C.total("confirmed")} AS f FROM ({REOPENS}))""",
        True,
    ),
    "q_classified_pct": (
        lambda d: D.classified(d, P, ALL),
        f"SELECT CAST(floor(100.0 * count(*) FILTER (category <> 'Другое') / count(*) + 0.5) AS BIGINT) AS classified_pct FROM ticket WHERE {C.between('opened_at')}",
        True,
    ),
    "q_heatmap_avg": (
        lambda d: D.heatmap_average(d, P, ALL),
        f"""WITH days AS (SELECT isodow(unnest(range({C.S}, {C.E}, INTERVAL 1 DAY))) AS w), often AS (SELECT w, count(*) AS k
          FROM days GROUP BY w)
        SELECT CAST(w - 1 AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, CAST(floor(count(*) /
          any_value(k)::DOUBLE + 0.5) AS BIGINT) AS messages
        FROM message JOIN often ON w = isodow(created_at) WHERE {C.between("created_at")} GROUP BY ALL""",
        False,
    ),
    "q_category_trend": (
        lambda d: D.category_trend(d, P, ALL),
        f"""WITH t AS ({TREND}), top AS (SELECT category FROM t WHERE category <> 'Другое' GROUP BY category ORDER BY
          sum(requests) DESC, category LIMIT 6),
        n AS (SELECT category FROM top UNION ALL SELECT 'Прочие'), p AS (SELECT bucket, CASE WHEN category IN (SELECT category
          FROM top) THEN category ELSE 'Прочие' END AS category, requests FROM t)
        SELECT b.bucket, n.category, {C.total("requests")} AS requests FROM (SELECT DISTINCT bucket FROM t) b CROSS JOIN n LEFT
          JOIN p ON p.bucket = b.bucket AND p.category = n.category GROUP BY ALL""",
        True,
    ),
    "sort_numeric_collation": (
        lambda d: D.numbered_clients(d),
        f"SELECT client, CAST(row_number() OVER (ORDER BY k, client) AS INTEGER) AS place FROM (SELECT DISTINCT client, {KEY} AS k FROM client_group)",
        False,
    ),
    "fn_humanize_seconds": (
        lambda d: d.ticket.select("id", D.humanized(F.col("frt_seconds")).alias("frt")),
        """SELECT id, CASE WHEN frt_seconds IS NULL THEN '-' WHEN frt_seconds < 60 THEN frt_seconds || ' с' WHEN frt_seconds <
          3600 THEN (frt_seconds // 60) || ' мин ' || lpad(CAST(frt_seconds % 60 AS VARCHAR), 2, '0') || ' с'
        ELSE (frt_seconds // 3600) || ' ч ' || lpad(CAST(frt_seconds % 3600 // 60 AS VARCHAR), 2, '0') || ' мин' END AS frt FROM ticket""",
        True,
    ),
    "fn_working_seconds": (
        lambda d: d.ticket.select("id", W.seconds_between(F.col("opened_at"), F.col("last_activity")).alias("seconds")),
        f"SELECT id, CASE WHEN last_activity > opened_at THEN {C.index_sql('last_activity')} - {C.index_sql('opened_at')} ELSE 0 END AS seconds FROM ticket",
        True,
    ),
    "fn_buckets": (
        lambda d: d.message.select(
            "source_id", *(W.bucket(F.col("created_at"), u).alias(u) for u in ("day", "week", "month")),
            W.next_working_day(F.col("created_at")).alias("shifted"),
            W.arrival_class(F.col("created_at")).alias("arrival")
        ),
        f"""SELECT source_id, {C.bucket("created_at", "day")} AS day, {C.bucket("created_at", "week")} AS week,
          {C.bucket("created_at", "month")} AS month, {C.shifted("created_at")} AS shifted,
        CASE WHEN isodow(created_at) >= 6 THEN 'weekend' WHEN {C.OFF} THEN 'night' ELSE 'working' END AS arrival FROM message""",
        False,
    ),
    "join_self_reopen": (
        lambda d: d.ticket.alias("t").join(d.ticket.alias("p"), F.col("t.reopened_from") == F.col("p.id")).select(
            "t.id", F.col("p.id").alias("before"), "t.reopen_score", F.col("p.status").alias("before_status")
        ),
        "SELECT t.id, p.id AS before, t.reopen_score, p.status AS before_status FROM ticket t JOIN ticket p ON p.id = t.reopened_from",
        True,
    ),
    "join_previous_message": (
        lambda d: d.message.select(
            "source_id",
            F.lag("direction").over(M.Window.partitionBy("client").orderBy("created_at", "source_id")).alias("before")
        ),
        "SELECT source_id, lag(direction) OVER (PARTITION BY client ORDER BY created_at, source_id) AS before FROM message",
        False,
    ),
    "join_latest_ticket": (
        lambda d: d.ticket.groupBy("client", "status").agg(
            F.max(F.struct("opened_at", "id")).alias("t")
        ).select("client", "status", "t.opened_at", "t.id"),
        "SELECT client, status, opened_at, id FROM (SELECT *, row_number() OVER (PARTITION BY client, status ORDER BY opened_at DESC, id DESC) AS r FROM ticket) WHERE r = 1",
        True,
    ),
    "limit_first3_texts": (
        lambda d: verdicts.candidates(d.ticket, d.message),
        f"{TEXTS} SELECT id, client, opened_at, before, now FROM texts", True
    ),
    "q_verdicts": (
        lambda d: verdicts.judged(d.ticket, d.message, same_first_word, budget=None),
        f"{TEXTS} SELECT client, opened_at, {SAME} AS verdict FROM texts WHERE pending",
        True,
    ),
    "q_verdicts_within_budget": (
        lambda d: verdicts.judged(d.ticket, d.message, same_first_word),
        f"{TEXTS} SELECT client, opened_at, {SAME} AS verdict FROM texts WHERE pending ORDER BY id LIMIT 60",
        True,
    ),
    "q_reopens_judged": (
        lambda d: M.reopens(_judged(d), P, ALL),
        f"{JUDGED} {C.REPORTS['q_reopens'][1].replace('ticket', 'judged')}",
        True,
    ),
    "q_clients_judged": (
        lambda d: M.clients(_judged(d), P, ALL),
        f"{JUDGED}, {C.CLIENTS.strip()[5:].replace('FROM ticket', 'FROM judged')}", True
    ),
    **{f"q_facts_{k}": (_facts(k), _fact_sql(k), True) for k in FACTS},
    "q_drill_events": (_events, EVENTS, True),
    "q_visible_groups": (
        lambda d: scope.visible_groups(d.grants, d.desk_groups),
        f"{GRANTS} SELECT DISTINCT usr AS \"user\", lower(grp) AS grp FROM g WHERE grp IS NOT NULL", False
    ),
    "q_visible_groups_chats": (
        lambda d: scope.visible_groups(d.grants, d.desk_groups, "chats"),
        f"{GRANTS.replace('AND can_metrics', 'AND can_chats')} SELECT DISTINCT usr AS \"user\", lower(grp) AS grp FROM g WHERE grp IS NOT NULL",
        False
    ),
    "q_scope": (
        lambda d: scope.scopes(d.grants, d.desk_groups),
        f"""{GRANTS} SELECT usr AS "user", coalesce(string_agg(DISTINCT account, ',' ORDER BY account), '') AS accounts,
        coalesce(string_agg(DISTINCT CASE WHEN account IS NULL THEN lower(grp) END, ',' ORDER BY CASE WHEN account IS NULL THEN
          lower(grp) END), '') AS own_groups FROM g GROUP BY usr""",
        False,
    ),
    "scope_only_group": (
        lambda d: M.heatmap(d, P, C.SOME.narrowed("ORG2")),
        f"""SELECT CAST(isodow(created_at) - 1 AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS
          messages FROM message
        WHERE {C.between("created_at")} AND {C.SOME_MESSAGES} AND client IN (SELECT client FROM client_group WHERE grp = 'org2')
          GROUP BY ALL""",
        False,
    ),
    "like_ci": (
        lambda d: M.heatmap(d, P, Scope(accounts=("HELP",), groups=("Org1", "ORG2"))),
        f"""SELECT CAST(isodow(created_at) - 1 AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS
          messages FROM message
        WHERE {C.between("created_at")} AND {C.SOME_MESSAGES} GROUP BY ALL""",
        False,
    ),
    "like_ci_groups": (lambda d: M.groups(_spelt(d), ALL), f"{SPELT} SELECT DISTINCT grp AS group_name FROM spelt WHERE lower(grp) NOT LIKE 'help%' AND lower(grp) <> 'all'", False),
    "like_ci_companies": (
        lambda d: M.companies(_spelt(d), P, ALL), SPELT + ", " + C.REPORTS["q_companies"][1].strip()[5:].replace("FROM client_group", "FROM spelt"), True
    ),
    "like_ci_scope": (
        lambda d: M.heatmap(_spelt(d), P, Scope(accounts=("HELP",), groups=("Örg1", "ORG2"))),
        f"""SELECT CAST(isodow(created_at) - 1 AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS messages FROM message
        WHERE {C.between("created_at")} AND {C.SOME_MESSAGES} GROUP BY ALL""", False,
    ),
    "q_help_report_monthly": (
        lambda d: M.help_report_monthly(d, M.Period(datetime(2024, 1, 8), datetime(2024, 2, 11)), "help"),
        MONTHLY,
        True,
    ),
    "dedup_hash": (
        lambda d: d.message.select(
            "source_id",
            F.hex(archive.dedup_hash(F.col("client"), archive.iso_time(F.col("created_at")), F.col("txt"))).alias("hash")
        ),
        """SELECT source_id, upper(sha1(client || chr(0) || strftime(created_at, '%Y-%m-%dT%H:%M') || CASE WHEN second(created_at) = 0 THEN '' ELSE strftime(created_at, ':%S') END || chr(0) || txt)) AS hash FROM message""",
        False,
    ),
    "to_business_time": (
        lambda d: d.message.select(
            "source_id",
            archive.to_business_time(F.col("created_at"), "Asia/Yekaterinburg", "Europe/Moscow").alias("at")
        ),
        "SELECT source_id, created_at - INTERVAL 2 HOURS AS \"at\" FROM message",
        False,
    ),
    "to_business_time_summer": (
        lambda d: d.message.select("source_id", archive.to_business_time(F.expr("created_at + INTERVAL 75 DAYS"), "Europe/Berlin", "Asia/Yekaterinburg").alias("at")),
        """SELECT source_id, t + to_hours(CASE WHEN t < TIMESTAMP '2024-03-31 03:00:00' THEN 4 ELSE 3 END) AS "at" FROM (SELECT source_id, created_at + INTERVAL 75 DAYS AS t FROM message)""",
        False,
    ),
    "ingest_messages": (
        lambda d: archive.normalized(archive.archived(d.message)).select("client", "author", "recipient", "direction", "txt", "created_at"),
        "SELECT client, author, recipient, direction, txt, created_at FROM message",
        False,
    ),
    "scan_archive_keyset": (
        lambda d: archive.archived(d.message).where("id > 20000 AND txt IS NOT NULL").select("id", "username", "txt"),
        f"SELECT id, username, txt FROM ({ARCHIVE}) WHERE id > 20000",
        False,
    ),
    "scan_archive_jdbc": (_over_jdbc, f"SELECT id, username, txt FROM ({ARCHIVE}) WHERE id > 4000 AND (id <= 8000 OR id > 20000)", False),
    "sink_message_dedup": (
        lambda d: ingest.messages(_served(d).store).select("client", "author", "recipient", "direction", "txt", "created_at"),
        "SELECT client, author, recipient, direction, txt, created_at FROM message", False,
    ),
    "st_state_reload": (lambda d: ingest.tickets(_served(d).store).selectExpr(*SHOWN.replace("\n", " ").split(", ")), f"SELECT {SHOWN} FROM ticket", True),
    "sink_dim_refresh": (lambda d: _served(d).store.table("client_group"), "SELECT client, grp, last_seen_at FROM client_group", False),
    "sink_watermark": (
        lambda d: d.spark.createDataFrame([(_served(d).store.state()["watermark"],)], "watermark long"), f"SELECT max(id) AS watermark FROM ({ARCHIVE})", False
    ),
    "st_dedup": (
        lambda d: _served(d).store.find("seen", ingest.messages(_served(d).store), "dedup_hash").select(F.hex("dedup_hash").alias("hash")),
        "SELECT upper(sha1(client || chr(0) || 's' || lpad(CAST(source_id AS VARCHAR), 9, '0') || chr(0) || txt)) AS hash FROM message", False,
    ),
    "q_stored_timeseries": (lambda d: M.timeseries(_served(d).desk(P), P, ALL), C.timeseries("day"), True),
    "q_stored_summary": (lambda d: M.summary(_served(d).desk(P), P, ALL), C.SUMMARY, True),
    "scan_max_id": (lambda d: archive.archived(d.message).agg(F.max("id").alias("top")), f"SELECT max(id) AS top FROM ({ARCHIVE})", False),
    "scan_membership": (
        lambda d: archive.memberships(
            d.member.select(F.concat(F.upper("client"), F.lit("@desk")).alias("jid"), "grp"),
            d.member.where("last_seen_at IS NOT NULL").select(
                F.col("client").alias("username"),
                F.unix_seconds(F.col("last_seen_at").cast("timestamp")).alias("seconds")
            ).distinct(),
            "Asia/Yekaterinburg",
            "Europe/Moscow",
        ),
        "SELECT client, grp, last_seen_at + INTERVAL 3 HOURS AS last_seen_at FROM client_group",
        False,
    ),
    "scan_desk_groups": (
        lambda d: archive.desk_groups(*_rosters(d)),
        """SELECT DISTINCT CASE WHEN grp < 'org3' THEN 'help' WHEN grp < 'org5' THEN 'help-mag' ELSE 'help-dnk' END AS account, grp
        FROM client_group WHERE grp LIKE 'org%'""",
        False,
    ),
    "monthly_ranges": (
        _by_month,
        """WITH moved AS (SELECT created_at + to_days(CAST(source_id % 150 AS INTEGER)) AS created_at FROM message),
        ends AS (SELECT min(created_at) AS lo, max(created_at) AS hi FROM moved),
        months AS (SELECT date_trunc('month', created_at) AS m, count(*) AS messages FROM moved GROUP BY ALL)
        SELECT CAST(greatest(m, CAST(lo AS DATE)) AS DATE) AS first, CAST(least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, CAST(hi AS DATE)) AS DATE) AS last, messages
        FROM months, ends""",
        False,
    ),
    "role_areas": (
        lambda d: scope.open_areas(d.accounts),
        """WITH a AS (SELECT DISTINCT c_custkey % 40 AS n FROM customer)
        SELECT 'm' || n AS "user", unnest(CASE WHEN n % 8 = 0 THEN ['admin', 'metrics', 'chat', 'help', 'companies', 'users', 'groups']
          WHEN n % 8 < 5 THEN ['metrics', 'chat', 'help', 'companies', 'users', 'groups'] ELSE ['companies', 'users', 'groups'] END) AS area
        FROM a WHERE n % 11 <> 3""",
        False,
    ),
    "sink_json": (_as_json, f"SELECT {KEPT} FROM ticket", True),
    "sink_sheets": (
        _as_sheets,
        "SELECT 'tickets' AS section, status AS name, count(*) AS n FROM ticket GROUP BY ALL UNION ALL SELECT 'messages', direction, count(*) FROM message GROUP BY ALL",
        True,
    ),
    "sink_rewrite_buckets": (
        _stored,
        "SELECT client, count(*) AS tickets, CAST(sum(messages_in) AS BIGINT) AS messages_in FROM ticket GROUP BY client",
        True
    ),
    "ingest_stanza_ids": (
        lambda d: archive.archived(d.message).select("id", archive.stanza_id(F.col("xml")).alias("stanza")),
        """WITH c AS (SELECT source_id, 's' || lpad(CAST(source_id AS VARCHAR), 9, '0') AS stanza FROM message)
        SELECT source_id * 4 AS id, stanza FROM c WHERE source_id % 17 <> 0 UNION ALL SELECT source_id * 4 + 1, stanza FROM c
        UNION ALL SELECT source_id * 4 + 2, stanza FROM c WHERE source_id % 13 = 0 UNION ALL SELECT source_id * 4 + 3, stanza
          FROM c WHERE source_id % 19 = 0""",
        False,
    ),
}


def queries() -> dict:
    return {name: C._query(name, make) for name, (make, _, _) in REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: C.over(sql, tickets) for name, (_, sql, tickets) in REPORTS.items()}
