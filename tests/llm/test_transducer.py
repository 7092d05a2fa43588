import hashlib

import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from deskloom.llm import transducer as td
from .conftest import frame

PATH = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
TOK.no_truncation()
TOK.no_padding()
MERGES = td.Merges(PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lexicon(tmp_path, words):
    path = tmp_path / "words.bin"
    path.write_bytes(td.compile_lexicon(words, *MERGES.merge(words)))
    return f"file://{path}"


def test_same_ids_and_decoding_as_the_library(spark, made):
    docs = frame(spark, made)
    got = sorted((tuple(r) for r in td.digests(docs, PATH, td.build_lexicon(docs, PATH, words=150)).collect()), key=repr)
    want = []
    for k, t in made:
        ids = TOK.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(TOK.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    import pathlib
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        enc = td.Encoder(PATH, lexicon(pathlib.Path(d), [b"the", b"there", b"then"]))
        assert enc.encode([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing")]
    lex = td.Lexicon(td.mapped(lexicon(tmp_path, words)))
    found = lex.find([*words, b"wal", b"walkin", b"walkings", b"", b"zzz"])
    assert sorted(found[: len(words)].tolist()) == list(range(len(words))) and (found[len(words) :] == -1).all()
    assert len(lex.final) < sum(map(len, words)) / 3  # suffixes share states
    for w, i in zip(words, found.tolist()):
        assert lex.ids[lex.ends[i] : lex.ends[i + 1]].tolist() == TOK.encode(w.decode(), add_special_tokens=False).ids


def test_long_words_and_empty_table(spark, tmp_path):
    enc = td.Encoder(PATH, lexicon(tmp_path, []))
    for t in ("a" * 500, "ab" * 300, "-" * 999, "é" * 100):
        assert enc.encode([t])[0].tolist() == TOK.encode(t, add_special_tokens=False).ids
    docs = frame(spark, [])
    assert td.digests(docs, PATH, td.build_lexicon(docs, PATH)).count() == 0
