import hashlib
import random
import zlib

from hypothesis import given, settings, strategies as st

from deskloom.llm import piecewise_hash as ph
from .conftest import frame


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("ABCab", min_size=1, max_size=64), st.text("ABCab", min_size=1, max_size=64))
def test_common_subsequence(a, b):
    assert ph._common([a], [b])[0] == lcs(a, b)


def test_every_row_against_the_next(spark, made):
    got = sorted((tuple(r) for r in ph.against_next(frame(spark, made)).collect()), key=repr)
    rows = sorted(((k, t or "") for k, t in made), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()), reverse=True)
    want = []
    for i, (k, t) in enumerate(rows):
        u = rows[(i + 1) % len(rows)][1]
        e, f = ph.with_tail(t, u), ph.fingerprint(t)
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), f, ph.fingerprint(e), ph.likeness([f], [ph.fingerprint(e)])[0], ph.likeness([f], [ph.fingerprint(u)])[0]))
    assert got == sorted(want, key=repr)


def test_edges_of_tables(spark):
    assert ph.against_next(frame(spark, [])).count() == 0
    one = ph.against_next(frame(spark, [(1, "alone here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert [r.fingerprint for r in ph.fingerprints(frame(spark, [(1, None), (2, "")])).collect()] == ["4::", "4::"]


def test_a_small_edit_stays_near_and_other_texts_do_not():
    a = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    b = a[:1000] + "something else" + a[1000:]
    c = " ".join(f"term{i * 104729 % 1000}" for i in range(400))
    f, g, h = map(ph.fingerprint, (a, b, c))
    assert ph.likeness([f], [g])[0] > 0.8 and ph.likeness([f], [h])[0] < 0.3 and ph.likeness([f], [f])[0] == 1.0


def plain_fingerprint(text):
    """Byte by byte: a window of seven bytes says where a chunk ends, each chunk is a symbol."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "4::"

    def rolled(i):
        h = 0
        for k in range(i - 6, i + 1):
            h = (h * 0x01000193 + (data[k] if k >= 0 else 0)) % 2**32
        return (h * 0x9E3779B1) % 2**32 >> 8

    at = [rolled(i) for i in range(len(data))]

    def chunks(size):
        out, chunk = "", b""
        for i, h in enumerate(at):
            chunk += data[i : i + 1]
            if h % size == size - 1 and cut[0] < 63:
                cut[0] += 1
                out, chunk = out + symbol(chunk), b""
        return out + (symbol(chunk) if chunk else "")

    def symbol(chunk):
        h = zlib.crc32(chunk)
        return ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")[(h ^ (h >> 7) ^ (h >> 17)) % 64]

    block = 4
    while block * 64 < len(data):
        block *= 2
    while sum(h % block == block - 1 for h in at) < 32 and block > 4:
        block //= 2
    cut = [0]
    narrow = chunks(block)
    cut = [0]
    return f"{block}:{narrow}:{chunks(2 * block)}"


def edits(a, b):
    """Inserted and deleted symbols, by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] if x == y else 1 + min(row[-1], old[j]))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([0, 1, 6, 7, 40, 300, 3000, 20_000]), st.sampled_from(["ab ", "abcdefghij \n", "aé日👍 "]))
def test_fingerprint_like_a_loop_over_bytes(seed, n, letters):
    r = random.Random(seed)
    text = "".join(r.choice(letters) for _ in range(n))
    assert ph.fingerprint(text) == plain_fingerprint(text)


def test_likeness_is_the_edit_distance_of_signatures_at_one_block_size():
    r = random.Random(4)
    for n in (60, 900, 5000):
        a = "".join(r.choice("abcdef ") for _ in range(n))
        b = a[: n // 3] + "other words" + a[n // 2 :]
        (p, s1, s2), (q, t1, t2) = (plain_fingerprint(x).split(":") for x in (a, b))
        pairs = {p: s1, str(2 * int(p)): s2}, {q: t1, str(2 * int(q)): t2}
        want = [1 - edits(x, y) / (len(x) + len(y)) for k, x in pairs[0].items() if (y := pairs[1].get(k)) is not None and any(x[i : i + 4] in y for i in range(max(1, len(x) - 3)))]
        assert abs(ph.likeness([ph.fingerprint(a)], [ph.fingerprint(b)])[0] - max(want, default=0.0)) < 1e-12
