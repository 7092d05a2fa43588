import random

from deskloom.llm import preference as p

S = "pair_id long, turn long, role string, text string, last int"


def rows(spark, *r):
    return spark.createDataFrame([(*x, 0) for x in r], S)


def test_prompt_is_the_longest_common_prefix(spark):
    chosen = rows(spark, (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good"))
    rejected = rows(spark, (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "less"), (1, 3, "assistant", "bad"))
    r = p.pairs(chosen, rejected).first()
    assert (r.prompt_turns, r.prompt) == (2, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n")
    assert r.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\ngood<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["good<|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["bad<|end|>\n"]


def test_prefix_null_repeated_and_one_sided(spark):
    chosen = rows(spark, (1, 0, "user", None), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 5, "assistant", "only"))
    rejected = rows(spark, (1, 0, "user", None), (1, 1, None, "tail"), (2, 0, "user", "x"))
    got = {r.pair_id: r for r in p.pairs(chosen, rejected).collect()}
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == ("<|user|>\n<|end|>\n", "", "<||>\ntail<|end|>\n")
    assert got[2].prompt == "" and got[2].chosen.count("x") == 2 and got[2].rejected.count("x") == 1
    assert got[3].prompt_turns == 0 and got[3].rejected == "" and len(got[3].chosen_mask) == 1


def test_empty_table(spark):
    c = spark.createDataFrame([], "conv_id long, turn long, role string, text string, last int")
    assert p.answered_otherwise(c).count() == 0 and p.pairs(c, c, "conv_id").count() == 0


def plainly(data):
    """What ``answered_otherwise`` is to give, by dictionaries."""
    talks = {}
    for i, turn, role, text in data:
        if i is not None:
            talks.setdefault(i, []).append((-(1 << 63) if turn is None else turn, role, text))
    order = lambda m: (m[0], m[1] is not None, m[1] or "", m[2] is not None, m[2] or "")
    said = {i: max(t for t, r, _ in m if r == "assistant") for i, m in talks.items() if any(r == "assistant" for _, r, _ in m)}
    ids = sorted(said)
    render = lambda ms: "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for _, r, x in ms)
    out = {}
    for k, i in enumerate(ids):
        j = ids[(k + 1) % len(ids)]
        if i == j:
            continue
        c = sorted((m for m in talks[i] if m[0] <= said[i]), key=order)
        r = [m for m in c if m[0] < said[i]] + sorted(((said[i], *m[1:]) for m in talks[j] if m[0] == said[j] and m[1] == "assistant"), key=order)
        turns = sorted({t for t, _, _ in c + r})
        n = next((k for k, t in enumerate(turns) if [m for m in c if m[0] == t] != [m for m in r if m[0] == t]), len(turns))
        cut = lambda ms, k=n, t=turns: render([m for m in ms if m[0] in t[k:]])
        out[i] = (n, render([m for m in c if m[0] in turns[:n]]), cut(c), cut(r))
    return out


def test_next_conversation_with_a_reply(spark):
    """Gaps in ids, conversations without a reply, ties, nulls, repeated rows and long texts; each conversation with a reply gives a pair."""
    r = random.Random(8)
    data = []
    for i in r.sample(range(-50, 400), 90):
        for t in range(r.randint(1, 5)):
            for _ in range(r.choice([1, 1, 1, 2])):
                data.append((i, t, r.choice(["user", "assistant", "system", None]), r.choice(["yes", "no", None, "", "x" * 30000, "ünï 👍"])))
    data += data[:7] + [(None, 0, "assistant", "nobody"), (1000, None, "assistant", "no turn"), (1000, None, "user", "no turn")]
    got = {x.conv_id: (x.prompt_turns, x.prompt, x.chosen, x.rejected) for x in p.answered_otherwise(rows(spark, *data).withColumnRenamed("pair_id", "conv_id")).collect()}
    want = plainly(data)
    assert len(got) == len(want) > 40 and got == want
    assert p.answered_otherwise(rows(spark, (1, 0, "assistant", "alone"), (2, 0, "user", "no reply")).withColumnRenamed("pair_id", "conv_id")).count() == 0
