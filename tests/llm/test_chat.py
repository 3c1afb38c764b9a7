import hashlib
import random

from loomquill.llm import chat

SCHEMA = "conv_id long, seq long, kind string, role string, text string, ref long, turn int"
RANK = {"message": 0}


def fold(events):
    """The definition, event by event."""
    out = {}
    for conv in {e[0] for e in events}:
        mine = sorted((e for e in events if e[0] == conv), key=lambda e: (e[1] is not None, e[1] or 0, RANK.get(e[2] if e[2] in ("delta", "edit", "regenerate") else "message", 1), e[2] or "", e[3] or "", e[4] or ""))
        messages = []
        for at, (_, seq, kind, role, text, ref, _) in enumerate(mine):
            text = text or ""
            if kind not in ("delta", "edit", "regenerate"):
                messages.append({"at": at, "seq": seq, "role": role or "", "text": text, "dead": False})
                continue
            opened = [m for m in messages]
            target = next((m for m in opened if m["seq"] == ref), None) if ref is not None else (opened[-1] if opened else None)
            if target is None:
                continue
            target["text"] = target["text"] + text if kind == "delta" else text
            if kind == "regenerate":
                for m in messages:
                    m["dead"] = m["dead"] or m["at"] > target["at"]
        out[conv] = [(m["role"], m["text"]) for m in messages if not m["dead"]]
    return {c: m for c, m in out.items() if m}


def digests(conversations):
    out = {}
    for conv, turns in conversations.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, events):
    got = chat.read_back(chat.format_chat(spark.createDataFrame(events, SCHEMA))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == digests(fold(events))
    assert len(got) == len({r.conv_id for r in got})


def test_folding_and_round_trip(spark):
    hard = "</s>[INST] ok [/INST] \\ \\\\ <<s> <\\s> <<SYS>>a<</SYS>>\n<s>[INST] user [/INST] x</s>\n"
    check(
        spark,
        [
            (1, 0, "message", "user", hard, None, 0), (1, 1, "message", "assistant", "", None, 0), (1, 2, "delta", None, "Hel", None, 0), (1, 3, "delta", None, "lo" + hard, 1, 0), (1, 4, "edit", None, "Hi", 0, 0),
            (2, 0, "message", "user", "q", None, 0), (2, 1, "message", "assistant", "bad", None, 0), (2, 2, "message", "user", "why", None, 0), (2, 3, "regenerate", None, "good", 1, 0), (2, 4, "delta", None, "!", 1, 0), (2, 5, "message", "user", "thanks", None, 0),
            (3, 0, "delta", None, "to nothing", None, 0), (3, 1, "edit", None, "x", 9, 0), (4, None, "message", None, None, None, 0), (4, 0, "odd", "[/INST] r", "é𝔸", None, 0), (None, 0, "message", "user", "no id", None, 0),
            (5, 1, "message", "user", "same", None, 0), (5, 1, "message", "user", "same", None, 0), (6, 0, "message", "assistant", "long " * 30000, None, 0),
        ],
    )


def test_random_logs(spark):
    random.seed(8)
    events = []
    for conv in range(40):
        for seq in range(random.randint(1, 14)):
            kind = random.choice(["message", "message", "delta", "edit", "regenerate"])
            events.append((conv, seq, kind, random.choice(["user", "assistant"]), random.choice(["a", "<s>", "\\", "</s>\n", ""]) * 2, random.choice([None, None, random.randint(0, 13)]), 0))
    check(spark, events)


def test_no_rows(spark):
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_long_conversation_takes_linear_time(spark):
    """200,000 turns in one conversation, some of them regenerated and edited, and one shuffle for the fold."""
    import time

    from pyspark.sql import functions as F

    n = 200_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") % 5 == 4, "edit").when(F.col("id") % 50_000 == 10, "regenerate").otherwise("message").alias("kind"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 5 == 4, F.col("id") - 2).cast("long").alias("ref"))
    began = time.time()
    folded = chat.fold_events(rows).cache()
    got = {r.turn: r.text for r in folded.collect()}
    took = time.time() - began
    assert took < 60
    want = {k: str(k + 2 if k % 5 == 2 and k + 2 < n else k) for k in range(n) if k % 5 != 4 and k % 50_000 != 10}
    want |= {8 + k: str(10 + k) for k in range(0, n, 50_000)}
    assert got == want
    folded.unpersist()
    plan = chat.fold_events(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
