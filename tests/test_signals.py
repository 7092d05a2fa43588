import random
import re

import pytest
from pyspark.sql import functions as F

from deskloom.functions import signals as S
from deskloom.operators import tickets as T
from deskloom.sources.adapter import INBOUND, PHRASES


def said(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in rows.select("i", f(F.col("t"))).orderBy("i").collect()]


CLOSED = ["Заявка закрыта", "закрыта заявка", "заявка закрыта.", "ЗАЯВКА  ЗАКРЫТА", "зявка закрыта", "заявкка закрыта", "завяка закрыта", "заявкa закрытa", "закрытазаявка", "закрыто, заявка", "заявку закрыт"]
REJECTED = ["Заявка отклонена", "отклонена заявка", "заявка отклонёна"]
NEITHER = ["заявка не закрыта", "закрыть заявку", "заявка", "дверь закрыта", "не закрыта заявка", "заявка в работе", "", "заявление закрыто"]


def test_closure(spark):
    got = said(spark, CLOSED + REJECTED + NEITHER + ["заявка отклонена и заявка закрыта"], S.closure_status)
    assert got == ["closed"] * len(CLOSED) + ["rejected"] * len(REJECTED) + [None] * len(NEITHER) + ["closed"]


@pytest.mark.parametrize(
    "f,yes,no",
    [
        (S.is_ack, ["спасибо", "ok", "+", "Да, хорошо", "👍"], ["не помогло", "спасибо, не надо", "опять", "Спасибо! Можно еще папку", "где?", "спасибо " * 9]),
        (S.is_pure_ack, ["спсаибо, всё работает", "👍👍👍", "+", "cgfcb,j", "всё ок"], [".", "test", "123", "спасибо, но нет", "+?"]),
        (S.has_thanks, ["СПАСИБО", "thanks"], ["ок"]),
        (S.reopen_marker, ["Опять", "нет!", "так и не", " нет "], ["нет света", "готово"]),
        (S.starts_new_request, ["прошу помочь", "Здравствуйте, вопрос по принтеру", "x" * 201], ["Здравствуйте", "не работает", "опять " + "x" * 201, "спасибо", "x" * 200]),
        (S.is_substantive, ["уточните номер кабинета", "какой?"], ["пожалуйста, обращайтесь", "заявка в работе", "Заявка закрыта", "рады помочь"]),
    ],
)
def test_signals(spark, f, yes, no):
    got = said(spark, yes + no, f)
    assert got == [True] * len(yes) + [False] * len(no)


def test_topics(spark):
    texts = ["1С в бухгалтерии", "почти готово", "почта", "сеть", "сетка", "удалённый доступ", "дискуссия", "мышь", "ПРИНТЕР", "просто текст", "неподпись"]
    names = [r for r in said(spark, texts, lambda t: S.category_name(S.category_rank(t)))]
    assert names == ["1С", "Другое", "Почта", "Сеть", "Другое", "Удалёнка", "Другое", "Оборудование", "Печать", "Другое", "Другое"]


def test_lengths_count_utf16_units_and_strip_keeps_no_break_spaces(spark):
    assert said(spark, ["👍👍👍", "аб"], S.utf16_length) == [6, 2]
    assert said(spark, ["\t a  ", " b"], S.strip) == ["a ", "b"]


def test_labels_of_the_phrase_book(spark):
    rows = [(k, p) for k, ps in PHRASES.items() for p in ps]
    df = spark.createDataFrame([(i, "in" if k in INBOUND else "out", p[0]) for i, (k, p) in enumerate(rows)], "source_id long, direction string, txt string")
    df = df.selectExpr("*", "'c' AS client", "'a' AS author", "'r' AS recipient", "timestamp_ntz'2024-01-01 10:00:00' AS created_at")
    got = {r.source_id: r for r in T.signal_columns(df).collect()}
    bits = (T.ACK, T.PURE, T.THANKS, T.FRESH, T.MARKER, T.PROGRESS, T.ASKS)
    for i, (_, p) in enumerate(rows):
        r = got[i]
        closes = "closed" if r.said & T.CLOSES else "rejected" if r.said & T.REJECTS else None
        assert (r["rank"], *(int(bool(r.said & b)) for b in bits), closes) == p[1:], p[0]


def test_patterns_with_shared_beginnings_find_the_same(spark):
    """In texts of words and stems, cut and run together, each merged pattern is found where the plain one is."""
    r = random.Random(8)
    plain = [S.REOPEN_MARKERS, S.REQUEST, S.PURE_ACK, S.THANKS, S.STILL_BROKEN, S.NEW_REQUEST, *("|".join(stems) for _, stems in S.CATEGORIES), "|".join(S.ACK_WORDS)]
    words = [w for p in [*plain, "|".join(S.CHITCHAT)] for w in re.findall("[a-zа-яё0-9]+", p)]
    texts = [r.choice(["", " ", "Да, ", "не "]) + r.choice([" ", "", ", "]).join(w[: r.choice([99, 99, len(w) - 1])] for w in r.choices(words, k=r.randint(1, 4))) + r.choice(["", "!", " "]) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "нет", "нет!.", "о", "ок", "окей"]], "t string")
    differ = [F.count_if(F.col("t").rlike(f"(?iuU){f % p}") != F.col("t").rlike(f"(?iuU){f % S.one_of(p)}")) for p in plain for f in ("%s", "\\b(?:%s)")]
    found = [F.count_if(F.col("t").rlike(f"(?iuU){S.one_of(p)}")) for p in plain]
    row = list(df.agg(*(c.alias(f"c{i}") for i, c in enumerate(differ + found))).first())
    assert not any(row[: len(differ)]) and all(row[len(differ) :])


def test_strip_is_that_of_the_pattern(spark):
    odd = [f"{a}x y{b}" for a in ("", "\u2000 ", "\xa0", "\x85 ", "\u2007 ") for b in ("", "\n", " \x85", "\u3000\r\n", "\x85 ", "\u200b ")] + ["", " \t", "\x85", " \x85"]
    assert said(spark, odd, S.strip) == said(spark, odd, lambda t: F.regexp_replace(t, f"^{S._BLANK}|{S._BLANK}$", ""))
    assert said(spark, ["а" * 31, "👍" * 31, "👍" * 30, None], lambda t: S._longer(t, 60)) == [False, True, False, None]


def test_a_text_is_read_once(spark):
    """The patterns of a message's signals are each in the plan once, as is its stripping."""
    df = spark.createDataFrame([], "source_id long, client string, author string, recipient string, direction string, txt string, created_at timestamp_ntz")
    plan = T.signal_columns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("овторн") == plan.count("rim(") == 1
