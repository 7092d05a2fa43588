import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from deskloom.llm import crf_lang, secret_scan
from deskloom.llm.queries import BYTE_BPE
from .test_crf_lang import say
from .test_ngram_join import brute
from .test_quality_cascade import figures, rejected
from .test_secret_scan import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "0f3c9a7be1d24865bb0c2f1e9d8a7766554433aa"


def corpus():
    """Clean texts of three languages, code-switched ones, near and exact copies, junk, secrets, nulls, repeated ids."""
    r = random.Random(3)
    rows = [(i, say(r, lang, r.randint(40, 90)), lang) for i in range(75) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(100 + i, say(r, "en", 30) + " " + say(r, "de", 30), None) for i in range(6)]  # half in each language
    for i in range(8):
        words = rows[i][1].split()
        words[-1] = "changed"  # a near copy
        rows.append((200 + i, " ".join(words), rows[i][2]))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(5)]
    rows += [(400 + i, f'{say(r, "fr", 40)} token = "{SECRET[i:]}{SECRET[:i]}" {say(r, "fr", 10)}', "fr") for i in range(8)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "too few words", "en"), (503, "a b c d e f g h " * 9, "en"), (504, "1234 5678 " * 20, None), (505, "# $ % " * 30, None)]
    rows += [rows[9], (rows[10][0], rows[11][1] + " and more", "en"), (None, say(r, "de", 50), "de"), (600, say(r, "en", 6000), "en")]
    return [(k, t, lang, "s", None if t is None else len(t)) for k, t, lang in rows]


def kept_by_hand(spark, rows):
    """Stage by stage, text by text; models are learned by the operators' own ``fit`` from the same rows."""
    rows = [x for x in rows if not rejected(figures(x[1]))]
    model = crf_lang.fit(spark.createDataFrame(rows, SCHEMA), cp.F.lit(True))
    good = []
    for x in rows:
        words = crf_lang.words(x[1])
        q = crf_lang.Tagger(model).tag([words])[0] if words else None
        if q is not None and q.max(axis=1).mean() >= 0.5:
            good.append(x)
    groups = {}
    for i, (_, n, component) in enumerate(_unsorted(good)):
        groups.setdefault((component, n > 0) if n else i, []).append(good[i])
    first = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    net = secret_scan.fit(spark.createDataFrame(first, SCHEMA))
    out = []
    for x in first:
        spans = secret_scan.all_spans([x[1]], net)[0][1]
        assert {s for s in plain(x[1])} <= set(spans)
        out.append((x[0], secret_scan.masked(x[1], spans)))
    return out


def _unsorted(rows):
    """brute() by row, in the order of the rows: ids are numbered anew, so that each row is told apart."""
    found = brute([(i, x[1]) for i, x in enumerate(rows)], 5, 80)
    return [r for _, r in sorted((r[0], r) for r in found)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    want = kept_by_hand(spark, rows)
    tok, pieces, ids = Tokenizer.from_file(BYTE_BPE), {}, []
    for p in got:
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    expected = sorted(((k, np.asarray([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")) for k, t in want), key=lambda x: (repr(x[0]), len(x[1])))
    assert sorted(((k, n) for k, n in pieces), key=repr) == sorted(((k, len(x)) for k, x in expected), key=repr)
    for k, x in expected:
        at = 0
        for p in sorted(pieces[k, len(x)], key=lambda p: p.start):
            assert p.start == at and zlib.crc32(x[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(x)
        ids.append(k)
    assert set(range(100, 106)) <= set(ids) and set(range(400, 408)) <= set(ids)  # code-switched texts and those with masked secrets stay
    assert not {200, 201, 300, 301, 500, 501, 502, 503, 504, 505} & set(ids)
    bins = {}
    for p in got:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048


def test_stages_keep_the_columns(spark, tmp_path):
    rows = corpus()[:30]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_without_labels_nothing_is_lost(spark):
    docs = spark.createDataFrame([(i, "some clean words in a text", None, "s", 26) for i in range(3)], SCHEMA)
    assert cp.language_id(spark, docs, "").count() == 3
