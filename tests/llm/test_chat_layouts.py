"""Layouts with context, history, reasoning and calls: nothing that is said is lost."""

import json

import pytest

from quern.llm import chat_format as C

CALL = {"name": "f", "arguments": '{"a": 1}'}
KEPT = [
    ({"instruction": "Do it", "input": "Now then", "output": "Yes", "history": [["Who are", "A model"], ["Ok", "Fine"]]}, [("user", "Who are"), ("assistant", "A model"), ("user", "Ok"), ("assistant", "Fine"), ("user", "Do it\n\nNow then"), ("assistant", "Yes")]),
    ({"instruction": "Do it", "output": "Yes", "history": []}, [("user", "Do it"), ("assistant", "Yes")]),
    ({"system": "Be kind", "instruction": "Do it", "response": "Yes", "history": [["a b", None]]}, [("system", "Be kind"), ("user", "a b"), ("assistant", ""), ("user", "Do it"), ("assistant", "Yes")]),
    ({"prompt": "Why so", "response": "So", "context": "It was night"}, [("user", "It was night\n\nWhy so"), ("assistant", "So")]),
    ({"question": "Why so", "answer": "So", "context": None}, [("user", "Why so"), ("assistant", "So")]),
    ({"system_prompt": "Be brief", "prompt": "Why", "completion": "So"}, [("system", "Be brief"), ("user", "Why"), ("assistant", "So")]),
    ({"messages": [{"role": "user", "content": "Call it"}, {"role": "assistant", "content": None, "function_call": CALL}]}, [("user", "Call it"), ("assistant", json.dumps(CALL))]),
    ({"messages": [{"role": "assistant", "reasoning_content": "It may be", "content": "It is"}], "id": "x17", "source": "web"}, [("assistant", "It may be\nIt is")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "See this"}, {"type": "image", "alt": "a red house"}]}]}, [("user", 'See this\n{"type": "image", "alt": "a red house"}')]),
]
WHOLE = [
    {"prompt": "Why so", "response": "So", "footnote": "but not on Sundays"},
    {"messages": [{"role": "user", "content": "Hi", "aside": {"deep": ["nothing", "much to say"]}}]},
    {"instruction": "Do it", "output": "Yes", "history": ["Who are you", "A model"]},
    {"instruction": "Do it", "output": "Yes", "history": "Who are you"},
    {"instruction": "Do it", "output": "Yes", "history": [["one", "two", "three"]]},
]


@pytest.mark.parametrize("record, turns", KEPT)
def test_records_keep_all_that_is_said(record, turns):
    name, got = C.record_turns(record, C.Registry())
    assert name and got == turns


@pytest.mark.parametrize("record", WHOLE)
def test_records_with_other_texts_are_given_back_whole(spark, record):
    assert C.record_turns(record, C.Registry()) == (None, [])
    df = spark.createDataFrame([(1, json.dumps(record))], "k long, j string")
    assert [tuple(r) for r in C.json_turns(df, "k", "j").collect()] == [(1, None, None, json.dumps(record), None)]


def test_tables_with_history_context_and_calls(spark):
    df = spark.createDataFrame([(1, "Do it", "ctx", "Yes", [["a", "b"]], "s"), (2, "Go", None, "No", None, None)], "conv_id long, instruction string, context string, output string, history array<array<string>>, system string")
    got = {}
    for r in C.table_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "Do it\n\nctx"), ("assistant", "Yes")], 2: [("system", ""), ("user", "Go"), ("assistant", "No")]}
    df = spark.createDataFrame([(1, [("assistant", "It is", ("f", "x"), "Hm")])], "conv_id long, messages array<struct<role: string, content: string, function_call: struct<name: string, arguments: string>, reasoning_content: string>>")
    assert [(r.role, r.text) for r in C.table_turns(df).collect()] == [("assistant", 'Hm\nIt is\n{"name":"f","arguments":"x"}')]
