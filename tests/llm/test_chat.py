import random

from symgrid.llm import chat as C

from .fixtures import DOCS, rows

LOG = "conv_id long, seq long, message_id long, kind string, role string, text string"


def fold(events):
    """The fold by its definition, one event after the other."""
    order = ["create", "edit", "regenerate", "delta", "delete"]
    n = lambda x: (x is not None, x or "")
    out = {}
    for conv in sorted({e[0] for e in events if e[0] is not None}):
        own = {e[1:] for e in events if e[0] == conv and e[1] is not None and e[2] is not None and e[3] in order}
        own = {(s, m, k, r, t or "") for s, m, k, r, t in own}
        msgs, past, at, role, text, dropped = [], {}, 0, 1, 2, 3
        for pos, (_, m, k, r, t) in enumerate(sorted(own, key=lambda e: (e[0], order.index(e[2]), e[1], n(e[3]), e[4]))):
            x = next((y for y in msgs if y[4] == m), None)
            if k == "delete":
                if x is not None:
                    msgs.remove(x)
                past[m] = True
                continue
            if x is None:
                if k == "delta" and past.get(m):
                    continue
                msgs.append(x := [pos, None, "", False, m])
            x[role] = x[role] or r
            if k == "regenerate":
                for y in msgs:
                    y[dropped] = y[dropped] or y[at] > x[at]
            x[text] = x[text] + t if k == "delta" else t
        out[conv] = [(x[role] or "user", x[text]) for x in sorted(msgs) if not x[dropped] and x[text].strip(" \n\t\r")]
    return out


def text_of(messages):
    clean = lambda t: t.replace(C.OPEN, "<| im_start|>").replace(C.CLOSE, "<| im_end|>")
    return "".join(f"{C.OPEN}{clean(r)}\n{clean(t)}{C.CLOSE}\n" for r, t in messages)


def test_random_logs_against_the_fold(spark):
    rng = random.Random(0)
    log = []
    for _ in range(3000):
        kind = rng.choice(["create", "delta", "delta", "delta", "edit", "regenerate", "delete"] if rng.random() < 0.4 else ["create", "delta"])
        log.append((rng.randrange(150), rng.randrange(40), rng.randrange(8), kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "bc ", "\n", "", None, C.OPEN, "é"])))
    log += log[:200]  # delivered twice
    rng.shuffle(log)
    want = {c: m for c, m in fold(log).items() if m}
    got = {r["conv_id"]: (r["n_messages"], r["text"]) for r in C.format_chats(spark.createDataFrame(log, LOG)).collect()}
    assert got == {c: (len(m), text_of(m)) for c, m in want.items()}


def test_stream_edit_regenerate(spark):
    log = [
        (1, 1, 10, "create", "user", "Hi"), (1, 2, 11, "create", "assistant", ""), (1, 3, 11, "delta", None, "Hel"), (1, 4, 11, "delta", None, "lo"), (1, 5, 12, "create", "user", "more"),
        (1, 6, 10, "edit", None, "Hi there"), (1, 7, 11, "regenerate", None, ""), (1, 8, 11, "delta", None, "Good day"),
    ]
    r = C.format_chats(spark.createDataFrame(log, LOG)).first()
    assert r["text"] == "<|im_start|>user\nHi there<|im_end|>\n<|im_start|>assistant\nGood day<|im_end|>\n" and r["n_messages"] == 2


def test_whole_turns_come_back(spark):
    turns = spark.read.parquet(f"{DOCS}/conversations.parquet")
    want = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {r["conv_id"]: r["text"] for r in C.format_chats(C.events_from_turns(turns)).collect()} == {c: text_of(m) for c, m in want.items()}


def test_deleted_messages_come_back(spark):
    log = [(1, 1, 1, "create", "user", "a"), (1, 2, 2, "create", "user", "b"), (1, 3, 1, "delete", None, None), (1, 4, 1, "delta", None, "lost"), (1, 5, 1, "create", C.OPEN, "again"), (1, 6, 1, "delta", None, "!")]
    assert rows(C.format_chats(spark.createDataFrame(log, LOG))) == [(1, 2, text_of([("user", "b"), (C.OPEN, "again!")]))]


def test_the_log_has_every_kind(spark):
    log = C.events_from_turns(spark.read.parquet(f"{DOCS}/conversations.parquet"))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"create", "delta", "edit", "regenerate", "delete"}


def test_edge_cases(spark):
    log = [(None, 1, 1, "create", "user", "x"), (1, None, 1, "create", "user", "x"), (1, 1, None, "create", "user", "x"), (1, 1, 1, "what", "user", "x"), (2, 1, 1, "create", None, None), (3, 1, 1, "delta", None, "y" * 200_000)]
    df = spark.createDataFrame(log, LOG).selectExpr("*", "1 as pos", "2 as at", "3 as k", "4 as m")
    assert rows(C.format_chats(df)) == [(3, 1, text_of([("user", "y" * 200_000)]))]
    assert rows(C.format_chats(spark.createDataFrame([], LOG))) == []
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 1, "user", "b\nc"), (None, 1, "user", "x"), (2, None, "user", "x"), (3, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert rows(C.format_chats(C.events_from_turns(turns))) == [(1, 1, text_of([("user", "b\nc")]))]
