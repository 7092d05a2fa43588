"""The queries themselves over a folder of small tables: op4 and op9 against their SQL, others against what their contracts fix."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from deskloom.llm import queries as Q
from .conftest import frame

COLUMNS = {
    "op1_token_shards": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op3_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op7_harmonic_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op10_transducer_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.fixture(scope="module")
def folder(spark, made, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    frame(spark, made).write.parquet(f"{path}/documents.parquet")
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}" if (c + t) % 5 else None) for c in range(9) for t in range(c % 6)]
    talk += [(20, 0, "user", "only"), (21, 0, None, "x"), (21, 1, "assistant", "y"), (21, 1, "assistant", "y")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op4_preference_pairs", "op9_quality_rules"])
def test_like_its_sql(spark, folder, name):
    got, con = Q.queries()[name](spark, folder), duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and len(want) > 4


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, folder, made, name):
    got = Q.queries()[name](spark, folder)
    assert set(got.columns) >= COLUMNS[name]
    rows = got.collect()
    byte, word = (Tokenizer.from_file(p) for p in (Q.BYTE_BPE, Q.WORD_BPE))
    ids = lambda tok, t: tok.encode(t or "", add_special_tokens=False).ids
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    if name == "op1_token_shards":
        assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((repr(k), len(x), crc(x)) for k, t in made for x in [[*ids(byte, t), 0]])
        ends = sorted((r.start, r.n_tokens) for r in rows)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0
    elif name == "op3_fingerprints":
        assert len(rows) == len(made) and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
        assert sorted((repr(r.doc_id), r.n_chars) for r in rows) == sorted((repr(k), len(t or "")) for k, t in made)
    elif name == "op7_harmonic_packing":
        pieces = sorted((repr(r.doc_id), r.doc_tokens) for r in rows if r.start == 0)
        assert pieces == sorted((repr(k), len(ids(byte, t)) + 1) for k, t in made)
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in map(sorted, by.values()):
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    else:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = [(repr(k), len(x), sha(" ".join(map(str, x))), sha(word.decode(x, skip_special_tokens=False))) for k, t in made for x in [ids(word, t)]]
        assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
