"""Help-desk tables derived from the ``events`` table, so that every report has an input with known content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DESKS = ("help", "help-mag", "help-dnk")

#: Phrases by event type, and what each says, labelled by hand:
#: text, topic rank, ack, pure ack, thanks, new request, marker, in progress, substantive, closes
PHRASES: dict[str, list[tuple]] = {
    "click": [
        ("Не печатает принтер в бухгалтерии", 1, 0, 0, 0, 0, 0, 0, 0, None),
        ("Спасибо, всё работает", 14, 1, 1, 1, 0, 0, 0, 0, None),
        ("Здравствуйте, нужно настроить почту на новом ноутбуке", 7, 0, 0, 0, 1, 0, 0, 0, None),
        ("Опять пропал интернет", 9, 0, 0, 0, 0, 1, 0, 0, None),
        ("Ок", 14, 1, 1, 0, 0, 0, 0, 0, None),
        ("Не помогло, ошибка та же", 14, 0, 0, 0, 0, 1, 0, 0, None),
        ("Заблокирован доступ к папке отдела", 11, 0, 0, 0, 0, 0, 0, 0, None),
    ],
    "view": [
        ("Подскажите, как подписать отчёт сертификатом", 2, 0, 0, 0, 0, 0, 0, 0, None),
        ("Благодарю за помощь", 14, 1, 1, 1, 0, 0, 0, 0, None),
        ("Добрый день, прошу выдать новый пароль", 11, 0, 0, 0, 1, 0, 0, 0, None),
        ("Касса не пробивает чек", 3, 0, 0, 0, 0, 0, 0, 0, None),
        ("+", 14, 1, 1, 0, 0, 0, 0, 0, None),
        ("Да, завис компьютер", 13, 0, 0, 0, 0, 0, 0, 0, None),
        ("Хорошо, понял вас", 14, 1, 1, 0, 0, 0, 0, 0, None),
    ],
    "error": [
        ("Так и не решено, телефон молчит", 6, 0, 0, 0, 0, 1, 0, 0, None),
        ("Здравствуйте, вопрос по 1С и по архиву документов", 1, 0, 0, 0, 1, 0, 0, 0, None),
        ("Спасибо, но сканер всё ещё мигает", 5, 0, 0, 1, 0, 1, 0, 0, None),
        ("Установите, пожалуйста, браузер", 10, 0, 0, 0, 1, 0, 0, 0, None),
        ("👍👍👍", 14, 0, 1, 0, 0, 0, 0, 0, None),
        ("Нет", 14, 0, 0, 0, 0, 1, 0, 0, None),
    ],
    "purchase": [
        ("Заявка закрыта", 14, 0, 0, 0, 0, 0, 0, 0, "closed"),
        ("Заявка в работе", 14, 0, 0, 0, 0, 0, 1, 0, None),
        ("Уточните, пожалуйста, номер кабинета", 14, 0, 0, 0, 0, 0, 0, 1, None),
        ("Заявка отклонена", 14, 0, 0, 0, 0, 0, 0, 0, "rejected"),
        ("Заявку закрыли, проверьте", 14, 0, 0, 0, 0, 0, 0, 1, None),
        ("Заявк закрыта", 14, 0, 0, 0, 0, 0, 0, 0, "closed"),
    ],
    "signup": [
        ("Закрыта заявка", 14, 0, 0, 0, 0, 0, 0, 0, "closed"),
        ("Заявка не закрыта", 14, 0, 0, 0, 0, 0, 0, 1, None),
        ("Пожалуйста, обращайтесь", 14, 0, 0, 0, 0, 0, 0, 0, None),
        ("В работе заявка, ждите", 14, 0, 0, 0, 0, 0, 1, 0, None),
        ("Какой у вас адрес?", 14, 0, 0, 0, 0, 0, 0, 1, None),
    ],
}
INBOUND = ("click", "view", "error")


def _phrase() -> Column:
    out = F.lit(None).cast("string")
    for kind, said in PHRASES.items():
        texts = F.array(*(F.lit(p[0]) for p in said))
        out = F.when(F.col("event_type") == kind, F.get(texts, F.pmod(F.col("event_id"), F.lit(len(said))).cast("int"))).otherwise(out)
    return out


def messages(events: DataFrame) -> DataFrame:
    """source_id, client, author, recipient, direction, txt, created_at."""
    shift = F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    desk = F.get(F.array(*map(F.lit, DESKS)), F.pmod(F.col("user_id") + shift, F.lit(3)).cast("int"))
    client, inbound = F.concat(F.lit("u"), F.col("user_id")), F.col("event_type").isin(*INBOUND)
    return events.select(
        F.col("event_id").alias("source_id"), client.alias("client"), F.when(inbound, client).otherwise(desk).alias("author"), F.when(inbound, desk).otherwise(client).alias("recipient"),
        F.when(inbound, "in").otherwise("out").alias("direction"), _phrase().alias("txt"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("created_at"),
    )


def memberships(events: DataFrame) -> DataFrame:
    """client, grp, last_seen_at."""
    users = events.groupBy("user_id").agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("seen"))
    org = lambda n: F.concat(F.lit("org"), F.pmod(F.col("user_id") + n, F.lit(7)))
    groups = F.array(F.lit("all"), org(0), F.when(F.col("user_id") % 10 == 0, org(3)).otherwise(org(0)))
    seen = F.when(F.col("user_id") % 4 != 0, F.col("seen"))
    return users.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("client"), F.explode(F.array_distinct(groups)).alias("grp"),
        seen.alias("last_seen_at")
    )


SERVED = {"help": ("org0", "org1", "org2"), "help-mag": ("org3", "org4"), "help-dnk": ("org5", "org6")}


def desk_groups(member: DataFrame) -> DataFrame:
    """account, grp: the groups with members that each desk serves."""
    desk = F.coalesce(*(F.when(F.col("grp").isin(*groups), account) for account, groups in SERVED.items()))
    return member.select(desk.alias("account"), "grp").where("account IS NOT NULL").distinct()


def accounts(customers: DataFrame) -> DataFrame:
    """user, role, enabled: those who may sign in, the same users as in ``grants``."""
    n = F.col("n")
    role = F.when(n % 8 == 0, "admin").when(n % 8 < 5, "manager").otherwise("user")
    return customers.select((F.col("c_custkey") % 40).alias("n")).distinct().select(
        F.concat(F.lit("m"), n.cast("string")).alias("user"), role.alias("role"), (n % 11 != 3).alias("enabled")
    )


def grants(customers: DataFrame) -> DataFrame:
    """user, scope_type, scope_value, can_metrics, can_chats; group names in capitals, as people type them."""
    k = F.col("c_custkey")
    desk = F.get(F.array(*map(F.lit, DESKS)), F.pmod(k, F.lit(3)).cast("int"))
    to_desk = k % 4 == 0
    return customers.select(
        F.concat(F.lit("m"), (k % 40).cast("string")).alias("user"),
        F.when(to_desk, "help_account").otherwise("group").alias("scope_type"),
        F.when(to_desk, desk).otherwise(F.concat(F.lit("ORG"), (F.col("c_nationkey") % 7).cast("string"))).alias("scope_value"),
        (k % 5 != 0).alias("can_metrics"),
        (k % 3 != 0).alias("can_chats"),
    ).distinct()


@dataclass
class Desk:
    """What reports read: messages, tickets, memberships, and the time just after the last message."""

    message: DataFrame
    ticket: DataFrame
    member: DataFrame
    horizon: object
    folder: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.message.sparkSession

    @property
    def grants(self) -> DataFrame:
        return grants(self.spark.read.parquet(f"{self.folder}/customer.parquet").select("c_custkey", "c_nationkey"))

    @property
    def accounts(self) -> DataFrame:
        return accounts(self.spark.read.parquet(f"{self.folder}/customer.parquet").select("c_custkey"))

    @property
    def desk_groups(self) -> DataFrame:
        return desk_groups(self.member)


_DESKS: dict[tuple[str, str], Desk] = {}


def forget() -> None:
    """Drop the tables that are held; to be called when what they were made from has changed."""
    for d in _DESKS.values():
        for df in (d.message, d.ticket, d.member):
            df.unpersist()
    _DESKS.clear()


def desk(spark: SparkSession, sf_dir: str) -> Desk:
    """The tables over ``events`` of a folder; those of the last folder asked for are held."""
    from ..operators.tickets import tickets

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DESKS:
        forget()
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        message = messages(events.repartition(tasks, "user_id")).persist()  # one small file would be one task
        last = message.agg(F.max("created_at") + F.expr("INTERVAL 1 SECOND")).first()[0]
        _DESKS[key] = Desk(message, tickets(message).persist(), memberships(events).persist(), last, sf_dir)
    return _DESKS[key]
