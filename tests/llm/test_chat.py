import json

import duckdb
import pytest

from lodestone.llm import chat, queries

TOOLS = json.dumps({"content": "sys", "tools": [{"name": "w", "parameters": {"type": "object", "properties": {"city": {"type": "string"}, "n": {"type": "integer"}, "x": {"type": "number"}, "u": {"type": "string", "enum": ["c", "f"]}, "l": {"type": "array"}}, "required": ["city"], "additionalProperties": False}}]})


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a, **({"depends_on": d} if d else {})} for i, n, a, d in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "clash") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, status string")
    return chat.format_messages(df).orderBy("conv_id", "order_turn", "order_level", "turn").collect()


def test_order_links_and_status(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("a", "early")), (1, 2, "assistant", call(("a", "w", '{"city":"x"}', None))), (1, 3, "assistant", call(("b", "w", '{"city":"y"}', ["c"]))),
        (1, 4, "tool", result("b", "yes")), (1, 5, "assistant", call(("c", "w", "{}", None))), (1, 6, "tool", result("c", "z")), (1, 7, "tool", result("zz", "?")), (1, 8, "tool", result("a", "again")),
        (2, 0, "tool", result("a", "other conversation")),
    ]
    got = [(r.conv_id, r.turn, r.status) for r in run(spark, rows)]
    assert got == [(1, 0, "plain"), (1, 2, "call"), (1, 1, "result"), (1, 8, "result"), (1, 5, "call"), (1, 6, "result"), (1, 3, "call"), (1, 4, "result"), (1, 7, "orphan"), (2, 0, "orphan")]


def test_cycles_keep_their_turns(spark):
    rows = [(1, 3, "assistant", call(("e", "w", "{}", ["f"]))), (1, 5, "assistant", call(("f", "w", "{}", ["e", "missing"]))), (1, 1, "assistant", call(("g", "w", "{}", ["g"])))]
    assert [(r.turn, r.order_turn) for r in run(spark, rows)] == [(1, 1), (3, 3), (5, 5)]


def test_arguments_are_checked(spark):
    good = ['{"city":"x"}', '{"n":3,"city":"x"}', '{"city":"x","x":1.5}', '{"city":"x","x":2}', '{"city":"x","u":"c"}', '{"city":"x","l":[1,"a"]}']
    bad = ["{}", '{"city":4}', '{"city":"x","n":"3"}', '{"city":"x","u":"q"}', '{"city":"x","k":1}', '{"city":"x","n":1.5}', "not json", "[1]", None, '{"city":"x","l":{}}', '{"city":null}']
    rows = [(1, 0, "system", TOOLS)] + [(1, i + 1, "assistant", call((f"i{i}", "w", a, None))) for i, a in enumerate(good + bad)] + [(1, 99, "assistant", call(("o", "unknown", "{}", None)))]
    got = {r.turn: r for r in run(spark, rows)}
    assert [got[i + 1].n_invalid for i in range(len(good))] == [0] * len(good)
    assert [got[len(good) + i + 1].n_invalid for i in range(len(bad))] == [1] * len(bad)
    assert got[99].n_invalid == 0 and "valid" not in got[99].json


def node(schema):
    return json.dumps({"tools": [{"name": "w", "parameters": {"type": "object", "properties": {"v": schema}}}]})


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": ["string", "null"]}, ['"x"', "null"], ["3", "[]"]),
        ({"type": "integer"}, ["12345678901234567890", "-3", "4.0", "1e3"], ["1.5", '"1"', "true"]),
        ({"type": "number", "minimum": 2, "maximum": 5.5}, ["2", "5.5"], ["1.99", "6"]),
        ({"type": "object", "required": ["k"], "properties": {"k": {"type": "array", "items": {"type": "object", "properties": {"d": {"type": "boolean"}}, "required": ["d"]}}}}, ['{"k":[{"d":true},{"d":false}]}', '{"k":[]}'], ["{}", '{"k":[{"d":1}]}', '{"k":[{}]}', '{"k":{}}']),
        ({"additionalProperties": {"type": "string"}}, ['{"a":"b"}', "{}"], ['{"a":1}']),
        ({"enum": ["a", None, 3]}, ['"a"', "null", "3"], ['"b"']),
    ],
)
def test_types_lists_bounds_and_nesting(spark, schema, good, bad):
    rows = [(1, 0, "system", node(schema))] + [(1, i + 1, "assistant", call((f"i{i}", "w", '{"v":' + v + "}", None))) for i, v in enumerate(good + bad)]
    got = {r.turn: r.n_invalid for r in run(spark, rows)}
    assert [got[i + 1] for i in range(len(good + bad))] == [0] * len(good) + [1] * len(bad)


def test_what_is_not_checked_has_no_verdict(spark):
    rows = [(1, 0, "system", node({"type": "string", "pattern": "a+"})), (1, 1, "assistant", call(("a", "w", '{"v":"b"}', None))), (1, 2, "assistant", call(("b", "w", '{"v":1}', None)))]
    got = {r.turn: r.json for r in run(spark, rows)}
    assert "valid" not in got[1] and '"valid":false' in got[2]


def test_long_chains_over_turns_need_no_rounds(spark):
    rows = [(1, i, "assistant", call((f"c{i}", "w", "{}", [f"c{i - 1}"] if i else None))) for i in range(60)]
    assert [(r.turn, r.order_turn, r.order_level) for r in run(spark, rows)] == [(i, i, 0) for i in range(60)]


def test_derived_links_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    expected = con.execute(queries.CHAT_LINKS_SQL).fetchall()
    out = queries.chat_links(spark, sf)
    names = [c[0] for c in con.description]
    got = [tuple(r) for r in out.select(*names).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r[names.index("status")] for r in got} == {"plain", "call", "result", "orphan"}


def test_json_is_canonical(spark):
    rows = [(1, 0, "system", TOOLS), (1, 1, "assistant", call(("a", "w", '{ "n": 3,\n "city" : "Zürich" }', None), ("b", "w", '{"city":"x"}', None), content='say "hi"\n'))]
    r = run(spark, rows)[1]
    assert r.n_calls == 2
    assert r.json == '{"content":"say \\"hi\\"\\n","role":"assistant","tool_calls":[{"arguments":"{\\"city\\":\\"Zürich\\",\\"n\\":3}","id":"a","name":"w","valid":true},{"arguments":"{\\"city\\":\\"x\\"}","id":"b","name":"w","valid":true}]}'


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (None, None, "user", "x"), (1, 1, "assistant", "{bad json"), (1, 2, "assistant", "[1]"), (1, 3, "tool", "plain"), (1, 3, "tool", "plain"), (1, 4, "user", ""), (1, 5, "assistant", "y" * 100000), (1, 6, "assistant", '{"a":1}'), (1, 7, "assistant", call((None, None, None, None)))]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].json == "{}" and by[1, 4].json == '{"content":"","role":"user"}' and by[1, 3].status == "plain"
    assert by[1, 6].json == json.dumps({"content": '{"a":1}', "role": "assistant"}, separators=(",", ":"))
    assert by[1, 7].status == "call" and by[1, 7].n_calls == 1
    assert run(spark, []) == []


def test_repeated_calls(spark):
    one = (1, 1, "assistant", call(("a", "w", "{}", None)))
    got = run(spark, [one, one, (1, 2, "assistant", call(("a", "w", '{"later":1}', None))), (1, 3, "tool", result("a", "r"))])
    assert [(r.turn, r.order_turn, r.status) for r in got] == [(1, 1, "call"), (1, 1, "call"), (3, 1, "result"), (2, 2, "call")] or [(r.turn, r.status) for r in got].count((1, "call")) == 2
