"""DuckDB SQL of the derived tables: an independent replay of the ticket rules over hand-labelled phrases."""

from __future__ import annotations

FIELDS = {
    "id": "BIGINT", "client": "VARCHAR", "account": "VARCHAR", "opened": "BIGINT", "opened_b": "BIGINT",
    "active": "BIGINT", "active_b": "BIGINT", "answered": "BIGINT", "responder": "VARCHAR", "frt": "BIGINT",
    "progress": "BIGINT", "pickup": "BIGINT", "closed": "BIGINT", "closed_b": "BIGINT", "closed_by": "VARCHAR",
    "resolution": "BIGINT", "status": "VARCHAR", "rank": "INTEGER", "m_in": "INTEGER", "m_out": "INTEGER",
    "reopened": "BIGINT", "score": "INTEGER", "llm": "VARCHAR", "thanked": "BOOLEAN", "waiting": "BIGINT",
    "waiting_b": "BIGINT", "replies": "INTEGER", "reply_s": "BIGINT", "resumes": "INTEGER",
}
STATE = "STRUCT(" + ", ".join(f"{n} {t}" for n, t in FIELDS.items()) + ")"


def _with(base: str, **changes: str) -> str:
    return "struct_pack(" + ", ".join(
        f"{n} := CAST({changes.get(n, f'{base}.{n}' if base else 'NULL')} AS {t})" for n, t in FIELDS.items()
    ) + ")"


def index(t: str) -> str:
    d = f"date_diff('day', DATE '2000-01-03', CAST({t} AS DATE))"
    sod = f"(hour({t}) * 3600 + minute({t}) * 60 + CAST(second({t}) AS BIGINT))"
    return f"(({d} // 7) * 180000 + least({d} % 7, 5) * 36000 + CASE WHEN {d} % 7 >= 5 THEN 0 ELSE least(greatest({sod}, 28800), 64800) - 28800 END)"


def _join(base: str) -> dict[str, str]:
    return {
        "m_in": f"{base}.m_in + 1", "active": "sec", "active_b": "b", "waiting": f"coalesce({base}.waiting, sec)",
        "waiting_b": f"CASE WHEN {base}.waiting IS NULL THEN b ELSE {base}.waiting_b END",
        "rank": f"least({base}.rank, mrank)"
    }


_RESUMED = _with(
    "l1",
    **(_join("l1") | {"status": "'open'", "closed": "NULL", "closed_b": "NULL", "closed_by": "NULL", "resolution": "NULL", "resumes": "l1.resumes + 1"})
)
_NEAR = f"(l1 IS NOT NULL AND ((l1.closed IS NOT NULL AND greatest(0, b - l1.closed_b) <= 36000) OR (l1.status = 'expired' AND greatest(0, b - l1.active_b - 72000) <= 36000)))"
_SCORE = "(2 * marker + CASE WHEN mrank = l1.rank AND mrank <> 14 THEN 1 ELSE 0 END)"
_NEW = _with(
    "", id="source_id", client="client", account="recipient", opened="sec", opened_b="b", active="sec", active_b="b",
    status="'open'", rank="mrank", m_in="1", m_out="0", thanked="false", replies="0", reply_s="0", resumes="0",
    reopened=f"CASE WHEN {_NEAR} THEN l1.id END", score=f"CASE WHEN {_NEAR} THEN {_SCORE} ELSE 0 END",
    llm=f"CASE WHEN {_NEAR} AND {_SCORE} = 0 THEN 'pending' END",
)
_OUT = {
    "m_out": "o1.m_out + 1", "active": "sec", "active_b": "b", "answered": "coalesce(o1.answered, sec)",
    "responder": "CASE WHEN o1.answered IS NULL THEN author ELSE o1.responder END",
    "frt": "CASE WHEN o1.answered IS NULL THEN greatest(0, b - o1.opened_b) ELSE o1.frt END",
    "replies": "o1.replies + CASE WHEN o1.answered IS NOT NULL AND o1.waiting IS NOT NULL THEN 1 ELSE 0 END",
    "reply_s": "o1.reply_s + CASE WHEN o1.answered IS NOT NULL AND o1.waiting IS NOT NULL THEN greatest(0, b - o1.waiting_b) ELSE 0 END",
    "waiting": "NULL", "waiting_b": "NULL",
    "progress": "CASE WHEN progress = 1 THEN coalesce(o1.progress, sec) ELSE o1.progress END",
    "pickup": "CASE WHEN progress = 1 AND o1.progress IS NULL THEN greatest(0, b - o1.opened_b) ELSE o1.pickup END",
}
_CLOSED = _with(
    "o1",
    **(_OUT | {"status": "closes", "closed": "sec", "closed_b": "b", "closed_by": "author", "resolution": "greatest(0, b - o1.opened_b)"})
)

# what each phrase says, labelled by hand: event type, phrases of it, number; text, topic, ack, pure ack, thanks, new request, marker, in progress, substantive, closes
_values = """
  ('click', 7, 0, 'Не печатает принтер в бухгалтерии', 1, 0, 0, 0, 0, 0, 0, 0, NULL),
  ('click', 7, 1, 'Спасибо, всё работает', 14, 1, 1, 1, 0, 0, 0, 0, NULL),
  ('click', 7, 2, 'Здравствуйте, нужно настроить почту на новом ноутбуке', 7, 0, 0, 0, 1, 0, 0, 0, NULL),
  ('click', 7, 3, 'Опять пропал интернет', 9, 0, 0, 0, 0, 1, 0, 0, NULL),
  ('click', 7, 4, 'Ок', 14, 1, 1, 0, 0, 0, 0, 0, NULL),
  ('click', 7, 5, 'Не помогло, ошибка та же', 14, 0, 0, 0, 0, 1, 0, 0, NULL),
  ('click', 7, 6, 'Заблокирован доступ к папке отдела', 11, 0, 0, 0, 0, 0, 0, 0, NULL),
  ('view', 7, 0, 'Подскажите, как подписать отчёт сертификатом', 2, 0, 0, 0, 0, 0, 0, 0, NULL),
  ('view', 7, 1, 'Благодарю за помощь', 14, 1, 1, 1, 0, 0, 0, 0, NULL),
  ('view', 7, 2, 'Добрый день, прошу выдать новый пароль', 11, 0, 0, 0, 1, 0, 0, 0, NULL),
  ('view', 7, 3, 'Касса не пробивает чек', 3, 0, 0, 0, 0, 0, 0, 0, NULL),
  ('view', 7, 4, '+', 14, 1, 1, 0, 0, 0, 0, 0, NULL),
  ('view', 7, 5, 'Да, завис компьютер', 13, 0, 0, 0, 0, 0, 0, 0, NULL),
  ('view', 7, 6, 'Хорошо, понял вас', 14, 1, 1, 0, 0, 0, 0, 0, NULL),
  ('error', 6, 0, 'Так и не решено, телефон молчит', 6, 0, 0, 0, 0, 1, 0, 0, NULL),
  ('error', 6, 1, 'Здравствуйте, вопрос по 1С и по архиву документов', 1, 0, 0, 0, 1, 0, 0, 0, NULL),
  ('error', 6, 2, 'Спасибо, но сканер всё ещё мигает', 5, 0, 0, 1, 0, 1, 0, 0, NULL),
  ('error', 6, 3, 'Установите, пожалуйста, браузер', 10, 0, 0, 0, 1, 0, 0, 0, NULL),
  ('error', 6, 4, '👍👍👍', 14, 0, 1, 0, 0, 0, 0, 0, NULL),
  ('error', 6, 5, 'Нет', 14, 0, 0, 0, 0, 1, 0, 0, NULL),
  ('purchase', 6, 0, 'Заявка закрыта', 14, 0, 0, 0, 0, 0, 0, 0, 'closed'),
  ('purchase', 6, 1, 'Заявка в работе', 14, 0, 0, 0, 0, 0, 1, 0, NULL),
  ('purchase', 6, 2, 'Уточните, пожалуйста, номер кабинета', 14, 0, 0, 0, 0, 0, 0, 1, NULL),
  ('purchase', 6, 3, 'Заявка отклонена', 14, 0, 0, 0, 0, 0, 0, 0, 'rejected'),
  ('purchase', 6, 4, 'Заявку закрыли, проверьте', 14, 0, 0, 0, 0, 0, 0, 1, NULL),
  ('purchase', 6, 5, 'Заявк закрыта', 14, 0, 0, 0, 0, 0, 0, 0, 'closed'),
  ('signup', 5, 0, 'Закрыта заявка', 14, 0, 0, 0, 0, 0, 0, 0, 'closed'),
  ('signup', 5, 1, 'Заявка не закрыта', 14, 0, 0, 0, 0, 0, 0, 1, NULL),
  ('signup', 5, 2, 'Пожалуйста, обращайтесь', 14, 0, 0, 0, 0, 0, 0, 0, NULL),
  ('signup', 5, 3, 'В работе заявка, ждите', 14, 0, 0, 0, 0, 0, 1, 0, NULL),
  ('signup', 5, 4, 'Какой у вас адрес?', 14, 0, 0, 0, 0, 0, 0, 1, NULL)
"""
_desk, _in = "['help', 'help-mag', 'help-dnk']", "('click', 'view', 'error')"
_names = """
  WHEN 1 THEN '1С'
  WHEN 2 THEN 'ЭЦП/Подпись'
  WHEN 3 THEN 'Касса/ККТ'
  WHEN 4 THEN 'Спец-ПО'
  WHEN 5 THEN 'Печать'
  WHEN 6 THEN 'Телефония'
  WHEN 7 THEN 'Почта'
  WHEN 8 THEN 'Удалёнка'
  WHEN 9 THEN 'Сеть'
  WHEN 10 THEN 'Программы/ПО'
  WHEN 11 THEN 'Доступ'
  WHEN 12 THEN 'Файлы/Диск'
  WHEN 13 THEN 'Оборудование'
"""

MESSAGE = f"""
phrase(kind, of, nth, txt, mrank, ack, pure, thanks, fresh, marker, progress, substantive, closes) AS (VALUES {_values}),
labelled AS (
  SELECT event_id AS source_id, 'u' || user_id AS client, CASE WHEN event_type IN {_in} THEN 'in' ELSE 'out' END AS direction,
         {_desk}[CAST((user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 3 AS INTEGER) + 1] AS desk,
           date_trunc('second', ts) AS created_at, p.*
  FROM events JOIN phrase p ON p.kind = event_type AND p.nth = event_id % p.of),
message AS (SELECT source_id, client, CASE direction WHEN 'in' THEN client ELSE desk END AS author, CASE direction WHEN 'in' THEN
  desk ELSE client END AS recipient, direction, txt, created_at FROM labelled),
client_group AS (
  SELECT DISTINCT 'u' || user_id AS client, g AS grp, CASE WHEN user_id % 4 <> 0 THEN seen END AS last_seen_at
  FROM (SELECT user_id, date_trunc('second', max(ts)) AS seen, unnest(['all', 'org' || (user_id % 7), CASE WHEN user_id % 10 = 0
    THEN 'org' || ((user_id + 3) % 7) ELSE 'org' || (user_id % 7) END]) AS g FROM events GROUP BY user_id)),
horizon AS (SELECT max(created_at) + INTERVAL 1 SECOND AS h FROM message)"""

TICKET = f"""
ev AS (SELECT *, CASE direction WHEN 'in' THEN client ELSE desk END AS author, CASE direction WHEN 'in' THEN desk ELSE client END
  AS recipient,
              {index("created_at")} AS b, CAST(epoch(created_at) AS BIGINT) AS sec, row_number() OVER (PARTITION BY client ORDER
                BY created_at, source_id) AS n FROM labelled),
rec AS (
  SELECT client, CAST(0 AS BIGINT) AS n, CAST(NULL AS {STATE}) AS o, CAST(NULL AS {STATE}) AS l, false AS osl FROM (SELECT
    DISTINCT client FROM ev)
  UNION ALL
  SELECT client, n,
         CASE what WHEN 'join' THEN {_with("o1", **_join("o1"))} WHEN 'resume' THEN {_RESUMED} WHEN 'new' THEN {_NEW} WHEN 'out'
           THEN {_with("o1", **_OUT)} WHEN 'close' THEN NULL ELSE o1 END,
         CASE what WHEN 'ack' THEN {_with("l1", thanked=f"l1.thanked OR greatest(0, b - l1.closed_b) <= 144000")} WHEN 'resume'
           THEN NULL WHEN 'close' THEN {_CLOSED} ELSE l1 END,
         what = 'idle' AND substantive = 1
  FROM (
    SELECT *, CASE WHEN direction = 'out' THEN CASE WHEN o1 IS NULL THEN 'idle' WHEN closes IS NOT NULL THEN 'close' ELSE 'out' END
                   WHEN o1 IS NOT NULL THEN 'join'
                   WHEN l1.closed IS NOT NULL AND ((ack = 1 AND greatest(0, b - l1.closed_b) <= 14400) OR pure = 1) AND NOT (osl
                     AND thanks = 0) THEN 'ack'
                   WHEN l1.closed IS NOT NULL AND sec - l1.closed <= 900 AND fresh = 0 THEN 'resume' ELSE 'new' END AS what
    FROM (
      SELECT ev.*, osl, CASE WHEN stale THEN NULL ELSE o END AS o1, CASE WHEN stale THEN {_with("o", status="'expired'")} ELSE l END AS l1
      FROM (SELECT rec.*, n + 1 AS nx FROM rec) r JOIN ev ON ev.client = r.client AND ev.n = r.nx, LATERAL (SELECT direction =
        'in' AND o IS NOT NULL AND b - o.active_b > 72000 AS stale) s))),
final AS (SELECT arg_max(t, n) AS t FROM (SELECT n, o AS t FROM rec WHERE o IS NOT NULL UNION ALL SELECT n, l FROM rec WHERE l IS
  NOT NULL) GROUP BY t.id),
flat AS (SELECT unnest(t) FROM final),
ticket AS (
  SELECT id, client, account, make_timestamp(opened * 1000000) AS opened_at, make_timestamp(active * 1000000) AS last_activity,
         CAST(DATE '2000-01-03' + CAST(((active_b + 72000) // 180000) * 7 + ((active_b + 72000) // 36000) % 5 AS INTEGER) AS
           TIMESTAMP) + to_seconds((active_b + 72000) % 36000 + 28800) AS stale_at,
         make_timestamp(answered * 1000000) AS first_response_at, responder AS first_responder, frt AS frt_seconds,
           make_timestamp(progress * 1000000) AS in_progress_at, pickup AS pickup_seconds,
         make_timestamp(closed * 1000000) AS closed_at, closed_by, resolution AS resolution_seconds, status, CASE rank {_names}
           ELSE 'Другое' END AS category, rank AS category_rank,
         m_in AS messages_in, m_out AS messages_out, reopened AS reopened_from, score AS reopen_score, llm AS reopen_llm,
           thanked, make_timestamp(waiting * 1000000) AS awaiting_since, replies, reply_s AS reply_seconds, resumes
  FROM flat)"""


def over(sql: str, tickets: bool = True) -> str:
    """A query over message, client_group, horizon and, if asked for, ticket."""
    sql = sql.strip()
    more = f",\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"\n{sql}"
    return f"WITH RECURSIVE {MESSAGE}{',' + TICKET if tickets else ''}{more}"
