import random

from ratelab.llm.chat import format_chats

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos string, chat string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", "c") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for n, (c, t, r, x) in enumerate(rows):
        convs.setdefault(("none", n) if c is None else ("id", c), []).append((t, r, x))
    none_first = lambda v: tuple((x is not None, x if x is not None else 0) for x in v)
    convs = {k: [(r, x) for _, r, x in sorted(v, key=none_first)] for k, v in convs.items()}
    out, seen = [], {}
    for k in sorted(convs, key=lambda k: (k[0] == "none", k[1])):
        own = convs[k]
        if any(len(v) > len(own) and v[: len(own)] == own for v in convs.values()):
            continue
        if tuple(own) in seen:
            seen[tuple(own)][2] += 1
            continue
        chat = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in own)
        seen[tuple(own)] = [None if k[0] == "none" else k[1], len(own), 1, chat]
        out.append(seen[tuple(own)])
    return sorted(map(tuple, out), key=repr)


def test_against_brute_force(spark, scratch):
    rng = random.Random(4)
    base = [[(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(1, 8))] for _ in range(10)]
    rows = []
    for c in range(70):
        own = rng.choice(base)
        for t, (r, x) in enumerate(own[: rng.randint(1, len(own))]):
            rows.append((c, t, r, x))
    rows += [(None, 0, "user", "a"), (None, None, None, None), (900, None, None, ""), (901, 1, "", None), (902, 0, "user", "x"), (902, 0, "user", "x")]
    rng.shuffle(rows)
    got = format_chats(frame(spark, rows), scratch)
    assert got.columns == ["conv_id", "n_turns", "copies", "chat"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_one_conversation_in_a_third_of_all_rows_and_a_long_one(spark, scratch):
    rows = [(c, t, "user", f"hot {t}") for c in range(60) for t in range(1 + c % 5)]
    rows += [(1000, t, "user", f"turn {t}") for t in range(3000)] + [(1001, t, "user", f"turn {t}") for t in range(2999)]
    got = {r.conv_id: (r.n_turns, r.copies) for r in format_chats(frame(spark, rows), scratch).collect()}
    assert got == {4: (5, 12), 1000: (3000, 1)}


def test_empty(spark, scratch):
    assert format_chats(frame(spark, []), scratch).count() == 0
