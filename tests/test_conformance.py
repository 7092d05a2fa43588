"""Texts, times and conversations with the results they must have."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from deskloom.functions import signals as S, working_time as W
from deskloom.operators import tickets as T
from .test_signals import said
from .test_tickets import run
from .test_working_time import between

# --- fixed values: what operators have written, and whether it ends a ticket ---
CLOSED = [
    "закрыта заявка", "ЗАЯВКА ЗАКРЫТА", "ЗАКРЫТА ЗАЯКА", "закрыта заявк", "закрыта заявкс", "закрыт заявка", "закрыта  заявка", "закрыта завка", "закрыта зявка", "закрыта заяввка", "закрыта заяака",
    "закрытаз заявка", "закрытазаявка", "закрыта щаявка", "закрытая заявка", "закрытк заявка", "закрыт азаявка", "закрыта заявк;а", "заявка  закрыта!!!!", "заявказакрыта", "заявк закрыта",
    "зявка закрыта", "заява закрыта", "заяввка закрыта", "закрыта зяавка", "закрыта азявка", "закрыта завяка", "заявка закрытп", "заявка закрыта, а вторая заявка отклонена",
]
REJECTED = ["отклонена заявка", "заявка отклонена", "заявкаотклонена", "заяявка отклонена", "заяка отклонена"]
NEITHER = [
    "могу закрыть заявку?", "заявку можем закрыть?", "можно заявку закрыть", "заявка не закрыта", "не закрыта", "нет, не закрыта", "1с нужно закрыть", "нужно закрыть все автокады", "удаленный доступ закрыт",
    "запрос на подключение отклонен", "пользователь отклоняет подключение", "вы отклонили запрос 2 раза", "заявка в работе", "подключаемся", "закрыта задача", "закрыта зая",
]
TOPICS = {
    "не работает принтер на втором этаже": "Печать", "Не могу зайти в Outlook": "Почта", "НЕ ПЕЧАТАЕТ ПРИНТЕР": "Печать", "в 1с не печатает принтер": "1С", "добрый день, подскажите пожалуйста": "Другое",
    "нужен новый картридж": "Печать", "почти готово, проверьте": "Другое", "Анатолий не может зайти": "Другое", "опечатка в договоре": "Другое", "дискуссия по проекту": "Другое",
    "гарантия на ноутбук": "Оборудование", "удаленные файлы восстановить": "Файлы/Диск", "не работает удаленный доступ": "Удалёнка", "не подключается VPN": "Удалёнка", "почта не приходит": "Почта",
    "касса не пробивает чек": "Касса/ККТ", "сломалась мышка": "Оборудование", "нет сети на втором этаже": "Сеть", "забыл пароль от учётной записи": "Доступ", "поставьте Консультант Плюс": "Спец-ПО",
}
PRINTER, CLOSES = "Не печатает принтер в регистратуре", "ЗАКРЫТА ЗАЯВКА"
# --- end of fixed values ---


def test_closing_phrases(spark):
    assert said(spark, CLOSED + REJECTED + NEITHER, S.closure_status) == ["closed"] * len(CLOSED) + ["rejected"] * len(REJECTED) + [None] * len(NEITHER)


def test_topics(spark):
    assert said(spark, list(TOPICS), lambda t: S.category_name(S.category_rank(t))) == list(TOPICS.values())
    assert said(spark, ["", "x"], lambda t: S.category_name(F.lit(0))) == ["Другое"] * 2


def at(day, hour, minute=0):
    return datetime(2026, 7, day, hour, minute)  # Monday is the 6th


def test_working_seconds(spark):
    pairs = {
        (at(6, 9), at(6, 11, 30)): 9000, (at(6, 6), at(6, 9)): 3600, (at(6, 17), at(6, 20)): 3600, (at(6, 17), at(7, 9)): 7200, (at(10, 17), at(13, 9)): 7200, (at(11, 10), at(12, 12)): 0, (at(6, 8), at(13, 8)): 180_000,
        (at(6, 11), at(6, 9)): 0, (at(6, 9), at(6, 9)): 0,
    }
    assert between(spark, list(pairs)) == list(pairs.values())


@pytest.mark.parametrize(
    "start,hours,end",
    [(at(6, 9), 2, at(6, 11)), (at(6, 17), 2, at(7, 9)), (at(10, 17), 2, at(13, 9)), (at(11, 12), 1, at(13, 9)), (at(13, 6), 1, at(13, 9)), (at(6, 10), 20, at(8, 10)), (at(9, 10), 20, at(13, 10))],
)
def test_plus_working_seconds(spark, start, hours, end):
    assert spark.createDataFrame([(start,)], "t timestamp_ntz").select(W.plus_seconds(F.col("t"), hours * 3600)).first()[0] == end


def test_reply_right_after_the_end_resumes(spark):
    (t,) = run(spark, ("0 10:00", 1, PRINTER), ("0 10:05", 0, "Перезагрузите принтер"), ("0 10:06", 0, CLOSES), ("0 10:07", 1, "как закрыта?"), ("0 10:20", 0, "Подключились, поправили драйвер"), ("0 10:21", 0, CLOSES))
    assert (t.status, t.closed_at.hour, t.closed_at.minute, t.messages_in, t.resumes) == ("closed", 10, 21, 2, 1)


def test_new_request_right_after_the_end(spark):
    first, second = run(spark, ("0 10:00", 1, PRINTER), ("0 10:06", 0, CLOSES), ("0 10:08", 1, "Установите, пожалуйста, 1С на второй компьютер"))
    assert second.reopened_from == first.id


def test_thanks_with_a_request(spark):
    assert len(run(spark, ("0 10:00", 1, PRINTER), ("0 10:06", 0, CLOSES), ("0 12:00", 1, "Спасибо! Можно еще папку сканов подключить"))) == 2


def test_late_thanks(spark):
    (t,) = run(spark, ("0 10:00", 1, PRINTER), ("0 10:06", 0, CLOSES), ("7 09:00", 1, "Спсибо, все работает"))
    assert not t.thanked


def test_yes_to_a_question(spark):
    first, _ = run(spark, ("0 10:00", 1, PRINTER), ("0 10:06", 0, CLOSES), ("0 11:00", 0, "Можем занять ваш ПК на полчаса?"), ("0 11:02", 1, "да"))
    assert not first.thanked


def test_return_after_expiry(spark):
    first, second = run(spark, ("0 10:00", 1, PRINTER), ("0 10:05", 0, "Проверим и отпишемся"), ("2 12:00", 1, "Что там по моему вопросу?"))
    assert (first.status, second.status, second.reopened_from, second.reopen_llm) == ("expired", "open", first.id, "pending")


def test_a_long_conversation(spark):
    got = run(
        spark, ("0 10:00", 1, PRINTER), ("0 10:06", 0, CLOSES), ("0 10:07", 1, "как закрыта?"), ("0 10:21", 0, CLOSES), ("0 11:00", 0, "Можем занять ваш ПК на полчаса?"), ("0 11:02", 1, "да"),
        ("0 11:30", 0, "Готово. ЗАКРЫТА ЗАЯВКА"), ("0 13:00", 1, "Спасибо!"), ("1 09:00", 1, "Нужен доступ к папке бухгалтерии"), ("1 09:05", 0, "Уточните у руководителя"),
        ("3 16:00", 1, "Руководитель согласовал"), ("3 16:10", 0, CLOSES), ("7 09:00", 1, "спасибо"),
    )
    assert len(got) == 4 and [t.thanked for t in got] == [False, True, False, True] and T.STALE_SPAN == 72_000
