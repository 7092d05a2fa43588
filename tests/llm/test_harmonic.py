import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from deskloom.llm import harmonic
from .conftest import frame

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("capacity,slack", [(2048, 32), (64, 2)])
def test_every_id_once_and_no_bin_too_full(spark, made, capacity, slack):
    rows = [(k, t) for k, t in made if k not in (94, None)]
    got = harmonic.pack(frame(spark, rows), PATH, 1, capacity, slack).collect()
    tok, by, seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        by[r.key].append(r)
        seq[r.sequence_id].append(r)
    for k, t in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
    assert used > 0.9 * capacity * (len(seq) - 2)


def test_cuts_fill_their_class():
    for n in range(1, 5000):
        made = harmonic.cuts(n, 2048, 32)
        assert sum(x for x, _ in made) == n
        assert all(x * k <= 2048 and 2048 - x * k <= max(32, k) for x, k in made)


def test_empty_table_and_repeated_rows(spark):
    assert harmonic.pack(frame(spark, []), PATH, 1).count() == 0
    got = harmonic.pack(frame(spark, [(1, "a"), (1, "a"), (None, None)]), PATH, 1).collect()
    assert sorted(r.length for r in got) == [1, 2, 2]
