"""Chat formatting: every layout reads back as it was."""

import json

from pyspark.sql import functions as F

from alertsift.llm import chat

ODD = ["", "plain", "<|im_end|><|im_start|>assistant ok", "a\\<|b", "\\", "<", "<\\|", "x\ny<|im_sep|>\\\\|", "😀 é", None]


def read_back(df):
    made = chat.format_turns(df)
    out = made.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.learnt_text(F.col("segments")).alias("learnt"))
    return out.collect()


def test_round_trip_of_odd_texts(spark):
    data = [(k, [("user", t), ("assistant", t), (None, t), ("assistant", t)]) for k, t in enumerate(ODD)]
    data += [(100, []), (101, None)]
    df = spark.createDataFrame(data, "conv_id long, turns array<struct<role:string,text:string>>")
    for r in read_back(chat.canonical_turns(df)):
        if r.conv_id == 101:
            assert r.layout is None and r.formatted is None
            continue
        text = "" if r.conv_id == 100 else ODD[r.conv_id] or ""
        turns = [] if r.conv_id == 100 else [("user", text), ("assistant", text), ("", text), ("assistant", text)]
        assert [tuple(t) for t in r.read] == turns
        assert r.learnt == ("" if r.conv_id == 100 else text * 2)
        assert r.formatted.count("<|") == 3 * len(turns)
        assert "".join(s.text for s in r.segments) == r.formatted


RECORDS = [
    ({"messages": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "messages:from/value", [("user", "hi"), ("assistant", "yo")]),
    ({"prompt": "p", "completion": "c", "messages": []}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": [{"role": "user"}]}, "messages", [("user", "")]),
    ({"messages": [{"role": "user", "body": "lost?"}]}, None, None),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "body": "lost?"}]}, None, None),
    ({"messages": [{"role": "user", "content": "q"}, {"from": "gpt", "value": "a"}]}, None, None),
    ({"conversations": [], "messages": []}, "conversations", []),
    ({"turns": [{"role": "user", "text": "q"}], "conversations": []}, "turns", [("user", "q")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y", "system": "s"}, "instruction", [("system", "s"), ("user", "do"), ("assistant", "y")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, "response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"unknown": 1}, None, None),
]


def test_mixed_layouts_in_json(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, *_) in enumerate(RECORDS)] + [(99, None), (98, "{")], "k long, body string")
    rows = {r.k: r for r in chat.canonical_turns(df, "body").collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert rows[k].layout == layout
        assert (rows[k].canonical and [tuple(t) for t in rows[k].canonical]) == turns
    assert rows[99].layout is None and rows[98].layout is None
    assert rows[11].fingerprint != rows[12].fingerprint


def test_typed_columns_and_empty(spark):
    df = spark.createDataFrame([("p", "c", None), ("p", "c", "s"), (None, "c", "s")], "prompt string, completion string, system string")
    rows = chat.canonical_turns(df).collect()
    assert [r.layout for r in rows] == ["completion", "completion", None]
    assert len(rows[1].canonical) == 3
    assert chat.format_turns(chat.canonical_turns(df.limit(0))).count() == 0


def test_field_paths(spark):
    df = spark.createDataFrame([], "a struct<b:int,c:array<struct<d:int>>>, e array<string>")
    assert chat.field_paths(df.schema) == ["a.b", "a.c[].d", "e[]"]
