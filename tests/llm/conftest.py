from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, node string, spans string"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the other columns clash with names that operators use inside."""
    full = [(*r[:2], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "k", 1, "x", "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def made():
    """Texts with nulls, empty and long ones, copies, ties and odd characters."""
    r = random.Random(4)
    words = ["".join(r.choice("abdeinorst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(r.randint(1, 120))) for i in range(60)]
    base = say(150).split()
    for i in range(60, 90):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = say(1)
        rows.append((i, " ".join(own)))
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, rows[3][1]), (94, rows[3][1].upper()), (94, rows[3][1].upper()), (95, "one"), (96, "one"), (97, "two words"), (98, say(6000))]
    rows += [(99, "tab\tand\x0bvertical\x1cseparator é ß İ Σ 日本 👍 <|endoftext|> <|startoftext|>x"), (100, "a b c"), (None, "no key at all"), (-5, "negative key"), (101, "!!!! ???? 1234")]
    return rows
