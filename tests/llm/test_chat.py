"""Chat logs folded and rendered, against a plain fold of lists and the texts themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat, queries

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def plain_fold(events):
    """(conv_id, message): (role, text), by one pass over sorted events."""
    state = {}
    for conv, seq, message, kind, role, text in sorted(set(events), key=lambda e: (e[1], e[3], e[4] is not None, e[4] or "", e[5] is not None, e[5] or "")):
        if kind == "regenerate":
            for key in [k for k in state if k[0] == conv and k[1] > message]:
                state[key]["live"] = False
        m = state.setdefault((conv, message), {"role": None, "text": "", "live": True})
        m["role"] = m["role"] if role is None else role
        if kind == "delete":
            m["live"] = False
        elif kind == "delta":
            m["text"] += text or ""
        else:
            m["text"], m["live"] = text or "", True
    return {k: (m["role"], m["text"]) for k, m in state.items() if m["live"]}


def test_fold_equals_a_plain_fold(spark):
    rng, events = random.Random(3), []
    for conv in range(40):
        opened = []
        for seq in range(rng.randrange(1, 60)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            if kind == "open" or not opened:
                message, kind = len(opened), "open"
                opened.append(message)
            else:
                message = rng.choice(opened)
            role = rng.choice(["user", "assistant"]) if kind == "open" else None
            events.append((conv, seq, message, kind, role, rng.choice([None, "", "a\n", "b<|im_end|>", "\\", "é"])))
    events += rng.choices(events, k=50)  # delivered again
    rng.shuffle(events)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(spark.createDataFrame(events, LOG)).collect()}
    assert got == plain_fold(events)


def test_fold_edges(spark):
    rows = [
        (1, None, 0, "open", "user", "x"), (1, None, 0, "delta", None, "y"), (1, 5, 0, "what", "user", "no"), (1, 6, 0, None, None, "no"),  # null seqs, other kinds
        (None, 1, None, "open", None, None), (2, 1, 0, "delta", None, "no open"), (3, 1, 0, "open", "user", "a"), (3, 2, 0, "delete", None, None),
        (4, 1, 0, "open", "user", "q"), (4, 2, 1, "open", "assistant", "a1"), (4, 3, 2, "open", "user", "q2"), (4, 4, 1, "regenerate", None, None), (4, 5, 1, "delta", None, "a2"), (4, 6, 2, "open", "user", "q3"),
    ]
    log = spark.createDataFrame(rows, LOG).withColumns({"log": F.lit(1), "start": F.lit(2), "first": F.lit("x"), "turns": F.lit(0)})
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(log).collect()}
    assert got == {(1, 0): ("user", "x"), (None, None): (None, ""), (2, 0): (None, "no open"), (4, 0): ("user", "q"), (4, 1): ("assistant", "a2"), (4, 2): ("user", "q3")}
    assert chat.format_chats(log.limit(0)).count() == 0


def test_texts_come_back_and_spans_fit(spark):
    rng = random.Random(5)
    bits = ["<", "[", "\\", "|im_end|>", "<|im_start|>", "<\\|im_sep|>", "</s>", "[INST]", "[\\\\/INST]", "/INST]", "é", "🤖", "\n", " ", "<s>", "$1"]
    turns = [(c, t, rng.choice(["user", "assistant", "a<|im_sep|>\nb", "", None]), rng.choice([None, ""]) if t == 0 else "".join(rng.choices(bits, k=rng.randrange(30)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    turns += [(60, 0, "assistant", "long " * 200_000), (61, 0, "user", "</s>[INST] ok [/INST]"), (61, 1, "assistant", "</s>[INST] ok [/INST]"), (62, None, "assistant", "b"), (62, None, "assistant", "b"), (62, None, "assistant", "a")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    rendered = chat.format_chats(chat.table_log(table))
    back = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.read_back(rendered).collect()}
    want = {}
    for c, _, role, text in sorted(turns, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    t = chat.TEMPLATE
    for r in rendered.collect():
        assert sum(r.formatted.count(s) for s in t.guarded) == 0 and r.formatted.count(t.start) == r.formatted.count(t.end) == len(r.turns)
        assert [s.start for s in r.turns] == [0, *[s.stop for s in r.turns][:-1]] and r.turns[-1].stop == len(r.formatted)
        for s, (role, text) in zip(r.turns, want[r.conv_id], strict=True):
            under = r.formatted[s.loss_start : s.loss_stop]
            assert r.formatted[s.start : s.stop].endswith(t.end) and (s.loss_stop > s.loss_start) == (role == "assistant" and text != "")
            assert role != "assistant" or len(under) >= len(text)
    digests = {r.conv_id: r for r in chat.digests(chat.read_back(rendered)).collect()}
    for c, said in want.items():
        loss = "".join(text for role, text in said if role == "assistant")
        assert (digests[c].n_turns, digests[c].loss_chars) == (len(said), len(loss)) and digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode()).hexdigest()


def test_other_templates(spark):
    log = chat.table_log(spark.createDataFrame([(1, 0, "tool", "#a# #b #\\b#"), (1, 1, "user", "hi")], "conv_id long, turn long, role string, text string"))
    template = chat.Template("#a#"[:2], "%b%"[:2], "@c", ("~d",))
    rendered = chat.format_chats(log, template, ("tool", "user"))
    assert [(m.role, m.text, m.loss) for m in chat.read_back(rendered, template).first().messages] == [("tool", "#a# #b #\\b#", "#a# #b #\\b#"), ("user", "hi", "hi")]
    for bad in (("<a", "<a", "<b"), ("<a", "a<", "<b"), ("<", "<a", "<b"), ("<\\a", "<c", "<b")):
        with pytest.raises(ValueError):
            chat.Template(*bad, ())


def test_the_query_has_one_more_conversation_and_no_python(spark, sf_dir):
    df = queries.op11_chat_format(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan and plan.count("Exchange") == 1
    rows = {r.conv_id: r for r in df.collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len("</s>[INST] ok [/INST]")
