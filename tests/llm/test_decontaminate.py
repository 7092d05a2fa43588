import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from deskloom.llm import decontaminate as D, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = {}
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (of := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    got |= of - {None}
        out.append((key, len(w), len(hit), tuple(sorted(map(str, got)))))
    return sorted(out, key=repr)


def made(n=60):
    r = random.Random(3)
    vocab = ["ab", "Cd", "éa", "x1", "ЖЗ", "q", "z9"]
    some = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(i, some(r.choice([3, 9, 10, 14, 25]))) for i in range(12)] + [(12, None), (13, " ,. "), (3, "ab Cd"), (None, some(12))]
    docs = [(i, some(r.randint(0, 40))) for i in range(n)]
    docs += [(1, items[4][1].replace(" ", " -- ").upper()), (None, items[15][1]), (None, None), (7, ""), (8, "x" * 5000), (9, (items[2][1] + "\n") * 300)]
    return docs + docs[-1:], items


@pytest.mark.parametrize("most", [D.BROADCAST_WINDOWS, 0])
def test_like_brute_force_on_both_paths(spark, most):
    docs, items = made()
    got = D.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=most)
    rows = sorted(((r.key, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()), key=repr)
    want = brute(docs, items)
    assert rows == want
    assert sum(r[2] > 0 for r in want) > 20 and any(len(r[3]) > 1 for r in want)


def test_empty_tables(spark):
    docs, items = made(3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.scan(d.where("false"), b).count() == 0
    assert {r.n_hit for r in D.scan(d, b.where("false")).collect()} == {0}


def test_removal_keeps_what_is_clean_and_clashing_columns(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    d = spark.createDataFrame(
        [(1, f"  Keep this; {passage.upper()}, and that.", 5, "a"), (2, "clean  text!", 6, "b"), (3, None, 7, "c"), (4, passage, None, None)],
        "doc_id long, text string, hash int, window string",
    )
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    whole = sorted(map(tuple, D.without_documents(d, b).collect()))
    assert whole == [(2, "clean  text!", 6, "b"), (3, None, 7, "c")]
    cut = {r[0]: r for r in D.without_spans(d, b).collect()}
    assert tuple(cut[1]) == (1, "  Keep this; and that.", 5, "a") and cut[4].text == ""
    assert cut[2].text == "clean  text!" and cut[3].text is None


def test_query_like_its_sql_without_python(spark, tmp_path):
    docs, items = made()
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_decontamination(spark, str(tmp_path))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP11_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
