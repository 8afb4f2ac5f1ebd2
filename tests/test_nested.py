import json

import pytest

from sievewright.operators import nested as N

RECORD = {
    "sample_id": "s1",
    "messages": [
        {"role": "user", "content": [{"type": "text", "text": "hi"}, None, {"type": "image", "image": "a.jpg"}]},
        None,
        json.dumps({"role": "assistant", "content": "x", "tool_calls": {"type": "function", "function": {"name": "f", "arguments": {"b": 1, "a": "é"}}}}),
    ],
    "images": json.dumps([{"image": "a.jpg"}]),
    "extra_info": json.dumps({"query_images": {"image_index": 1}, "wiki_pairs": [None, {"title": "T"}]}),
}


def children(payload):
    nodes = N.label_tree(payload, N.TRAJECTORY, False)
    at = {n[1]: n for n in nodes}
    out = []
    for n, p in zip(nodes, N.link_by_intervals(nodes), strict=True):
        if n[0] not in ("record", "broken", "extra_info"):
            out.append((n[0], at[p][3] if at[p][0] == "message" else 0, n[3]))
    return out


EXPECTED = [
    ("message", 0, 1), ("content_part", 1, 1), ("content_part", 1, 3), ("message", 0, 3), ("tool_call", 3, 1), ("image", 0, 1), ("query_image", 0, 1), ("wiki_pair", 0, 2),
]


def test_children_keep_positions_and_decode_text():
    assert children(json.dumps(RECORD)) == EXPECTED
    assert children(json.dumps(json.dumps(RECORD))) == EXPECTED


@pytest.mark.parametrize("payload", [None, "", "  ", "null", "[]", "3", '"-"', '{"messages": [', '{"a": 1} x', '{"a": NaN}', "[" * 100_000, '{"a": ' + "[" * 50_000 + "]" * 49_999 + "}", '{"a": ' + "[" * 50_000 + "]" * 50_000 + "} x", '{"a":' * 50_000 + "1," + "}" * 50_000])
def test_broken_payloads_have_no_children(payload):
    nodes = N.label_tree(payload, N.TRAJECTORY, True)
    assert [n[0] for n in nodes] == ["broken"]


def test_any_depth_and_any_number_of_encodings():
    text = json.dumps(RECORD)
    for _ in range(9):
        text = json.dumps(text)
    assert children(text) == EXPECTED
    deep = json.dumps(RECORD)[:-1] + ', "more": ' + '[{"a": [1, "b\\n", {}, []], "c": ' * 20_000 + "null" + "}]" * 20_000 + "}"
    assert children(deep) == EXPECTED
    nodes = N.label_tree(deep, N.TRAJECTORY, True)
    assert dict(nodes[0][4])["more"].startswith('[{"a":[1,"b\\n",{},[]],"c":[{')
    small = {"b": [1, {"x": None, "a": "é"}, []], "a": {}}
    assert N._read_deep(json.dumps(small)) == small and N._write_deep(small) == json.dumps(small, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for bad in ("", "[1,]", "{,}", '{"a" 1}', "[1 2]", "[1}", "01", "1 2", '{"a":1,}', "[,1]"):
        with pytest.raises(ValueError):
            N._read_deep(bad)


def test_intervals_contain_exactly_the_descendants():
    nodes = N.label_tree(json.dumps(RECORD), N.TRAJECTORY, True)
    parents = dict(zip([n[1] for n in nodes], N.link_by_intervals(nodes), strict=True))

    def above(pre):
        while parents[pre]:
            pre = parents[pre]
            yield pre

    for a in nodes:
        for b in nodes:
            assert (a[1] < b[1] and a[2] > b[2]) == (a[1] in set(above(b[1])))


def test_tables(spark):
    rows = [(1, json.dumps(RECORD), "x"), (1, json.dumps(RECORD), "y"), (2, None, None), (3, '{"messages": "\\ud800"}', "z")]
    df = spark.createDataFrame(rows, "record_id long, payload string, kind string")
    nodes = N.node_table(df, "record_id", "payload").cache()
    assert N.flat_table(nodes, "record_id", "message").count() == 4  # each delivery counts
    calls = N.flat_table(nodes, "record_id", "tool_call").collect()
    assert calls[0]["function_name"] == "f" and json.loads(calls[0]["arguments"]) == {"a": "é", "b": 1}
    assert sorted(r["status"] for r in N.flat_table(nodes, "record_id", "record").collect()) == ["broken", "ok", "ok", "ok"]
    once = nodes.dropDuplicates(["record_id", "pre"])
    joined = N.contained(N.flat_table(once, "record_id", "extra_info"), N.flat_table(once, "record_id", "wiki_pair"), "record_id")
    assert [(r["record_id"], r["title"]) for r in joined.collect()] == [(1, "T")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, payload string")
    assert N.node_table(df, "record_id", "payload").count() == 0


def test_long_record(spark):
    payload = json.dumps({"messages": [{"role": "user", "content": "x" * 1000}] * 3000})
    df = spark.createDataFrame([(1, payload)], "record_id long, payload string")
    assert N.flat_table(N.node_table(df, "record_id", "payload"), "record_id", "message").count() == 3000
