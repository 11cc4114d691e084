"""Chat records that can't be read or mapped, and many benchmark items."""

import json
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldgrid.llm import chat, decontaminate

ODD = ['{"prompt":"\\ud800","response":"x"}', '{"\\udfff":1}', '{"a":' * 20_000 + "1" + "}" * 20_000, "[" * 50_000, '{"prompt":"x","response":NaN}', "", None, "[]", "3", '{"prompt":', '{"a":{"b":[]}}']


def test_odd_records_get_null_turns(spark):
    good = '{"prompt":"p","response":"r"}'
    rows = spark.createDataFrame([(i, r) for i, r in enumerate([*ODD, good, good])], "conv_id long, record string")
    got = {r.conv_id: r for r in rows.select("conv_id", chat.format_record(F.col("record")).alias("x")).select("conv_id", "x.*").collect()}
    known = {i: got[i].layout for i in got if got[i].layout}
    assert known == {4: "prompt", len(ODD): "prompt", len(ODD) + 1: "prompt"} and all(got[i].formatted is None for i in got if i not in known)
    unknown = {r.fingerprint: r.n for r in chat.unknown_layouts(rows).collect()}
    assert unknown == {chat.fingerprint({"a.b[]"}): 1, None: len(ODD) - 2}


def test_lists_of_parts():
    known = chat.registry()
    for content, want in (([{"type": "text", "text": "hi"}], "hi"), ([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "ab")):
        record = {"messages": [{"role": "user", "content": content}, {"role": "assistant", "content": content}]}
        layout = known[chat.fingerprint(chat.paths(record))]
        assert chat.turns_of(record, layout) == [("user", want), ("assistant", want)]
    mixed = {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "plain"}]}
    assert chat.turns_of(mixed, known[chat.fingerprint(chat.paths(mixed))]) == [("user", "q"), ("assistant", "plain")]


LEAVES = st.none() | st.booleans() | st.integers() | st.floats() | st.text(st.characters(), max_size=5)
TREES = st.recursive(LEAVES, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["messages", "role", "content", "prompt", "response", "text", "type", "id", "\ud800"]), x, max_size=4), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(TREES, st.integers(0, 60))
def test_any_record_is_converted(tree, cut):
    known = chat.registry()
    for record in (json.dumps(tree), json.dumps(tree)[:cut], json.dumps({"messages": tree}), json.dumps({"prompt": tree, "response": tree})):
        layout, text, mask = chat._converted(record, known)
        assert (layout is None) == (text is None)
        if text is not None:
            assert chat.render(chat.read(text))[0] == text and isinstance(text.encode(), bytes)


def test_a_hundred_thousand_items(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(6))) for i in range(100_000)]
    texts = [(1, f"before {items[77][1]} after"), (2, None), (3, ""), (None, items[5][1]), (None, items[5][1]), (7, "x " * 40_000 + items[9][1])]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*items, (None, items[9][1])], "item_id long, text string")
    began = time.time()
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench).collect()), key=str)
    assert got == sorted([(1, 77), (None, 5), (None, 5), (7, 9), (7, None)], key=str)
    assert time.time() - began < 90
