import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from deskloom.llm import token_shards as ts
from .conftest import frame

PATH = P.path("byte_bpe_50k.json")


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out, at = [], 0
    for k, t in sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        out.append((k, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_of_files(spark, made):
    docs = frame(spark, made)
    path, manifest = ts.write_shards(docs, PATH, end_id=0, shards=3)
    found = ts.fetch(manifest, docs, "doc_id").unionByName(ts.without_key(manifest))
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])
    assert got == expected(made)
    scanned = [zlib.crc32(raw) for r in manifest.orderBy("shard").collect() for _, raw in ts.Shard(r.path, r.width).scan()]
    assert scanned == [r[3] for r in got]


def test_keyed_access(spark, made):
    _, manifest = ts.write_shards(frame(spark, made), PATH, end_id=0, shards=2)
    shards = [(r.lo, r.hi, ts.Shard(r.path, r.width)) for r in manifest.where("lo IS NOT NULL").collect()]
    tok = Tokenizer.from_file(PATH)
    for key in (7, 94, -5):
        (shard,) = [s for lo, hi, s in shards if lo <= key <= hi]  # one shard to open
        assert [x.tolist() for x in shard.lookup(key)] == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in made if k == key]
    assert not any(s.lookup(k) for _, _, s in shards for k in range(10_000, 10_400))
    asked = spark.createDataFrame([(94,), (94,), (None,), (10_000,), (-99,), (3,)], "key long")
    assert sorted(r.key for r in ts.fetch(manifest, asked).collect()) == [3, 94, 94]


def test_a_second_attempt_leaves_the_files(tmp_path):
    at = f"file://{tmp_path}/x"
    for _ in range(2):
        ts._put(at, lambda f: f.write(b"same"))
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and (tmp_path / "x").read_bytes() == b"same"


def test_shards_grow_with_the_rows(spark):
    rows = [(i, f"text {i}") for i in range(120)]
    few = ts.write_shards(frame(spark, rows), PATH, end_id=0)[1]
    many = ts.write_shards(frame(spark, rows), PATH, end_id=0, records=10)[1]
    assert few.count() <= 4 and 10 <= many.count() <= 12
    found = sorted((tuple(r) for r in ts.fetch(many, frame(spark, rows), "doc_id").collect()), key=lambda r: r[1])
    assert found == expected(rows)


def test_empty_table(spark):
    _, manifest = ts.write_shards(frame(spark, []), PATH, end_id=0)
    assert ts.fetch(manifest, frame(spark, [(1, "x")]), "doc_id").count() == 0 and ts.without_key(manifest).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 5000))
    ph = ts.PerfectHash.build(keys)
    assert sorted(ph.slots(keys).tolist()) == list(range(len(keys)))
    bits = np.unpackbits(ph.bits)
    at = np.flatnonzero(bits)
    assert ph.rank(at).tolist() == list(range(len(at)))
