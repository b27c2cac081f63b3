import json

from sitecount.llm import tool_calls as tc

SCHEMAS = {"f": (("x", "integer", True), ("note", "string", False)), "g": ()}


def calls(*made):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "depends_on": d} for i, n, a, d in made]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "assistant", calls(("a", "f", {"x": 1, "note": "é\n"}, []), ("b", "f", {"note": 2, "y": [1]}, ["a", "gone"]))),
    (1, 2, "tool", result("a", {"z": 1, "b": [1.5, None]})),
    (1, 3, "tool", result("q", "nobody asked")),
    (1, 4, "tool", result("a", "late")),
    (2, 0, "assistant", calls(("p", "g", {}, ["q"]), ("q", "g", {}, ["r"]), ("r", "g", {}, []), ("s", "h", {}, []))),
    (2, 1, "tool", result("p", 1)),
    (3, 0, "assistant", calls(("m", "g", {}, ["n"]), ("n", "g", {}, ["m"]), ("o", "g", {}, ["o"]), ("k", "g", {}, []))),
    (4, 0, "user", '{"tool_calls": broken'),
    (4, 0, "user", None),
    (5, 0, None, "x" * 50_000),
    (None, 0, "user", "who"),
]


def test_links_order_validation_and_canonical_json(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, level string")
    got = sorted(tc.numbered(tc.format_chat(df, SCHEMAS)).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.seq))
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.kind, r.call_id, r.status, r.level))
    assert by[1] == [
        ("message", None, "ok", 0),
        ("call", "a", "ok", 0),
        ("call", "b", "invalid:missing:x,type:note,unknown:y", 0),
        ("result", "q", "orphan_result", 0),
    ]
    assert by[2] == [("call", "r", "no_result", 0), ("call", "s", "invalid:unknown_tool", 0), ("call", "q", "no_result", 1), ("call", "p", "ok", 2)]
    assert by[3] == [("call", "k", "no_result", 0), ("call", "m", "cycle", None), ("call", "n", "cycle", None), ("call", "o", "cycle", None)]
    assert [x[0] for x in by[4]] == ["message"] * 2 and len(by[5]) == 1 and len(by[None]) == 1
    first = next(r for r in got if r.call_id == "a")
    assert first.json == '{"arguments":{"note":"é\\n","x":1},"id":"a","name":"f","result":{"b":[1.5,null],"z":1}}' and first.n_ignored == 1
    assert all(json.loads(r.json) is not None for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tc.format_chat(df).count() == 0
    assert tc.format_chat(tc.as_tool_messages(df)).count() == 0


def test_calls_and_results_without_a_key_or_with_a_taken_one_are_rows(spark):
    rows = [
        (None, 0, "assistant", calls(("a", "g", {}, []))),
        (None, 1, "tool", result("a", "who")),
        (1, 0, "assistant", calls(("a", "g", {}, []), (None, "g", {}, ["a", "gone"]), (None, "g", {}, ["a"]))),
        (1, 0, "assistant", calls(("a", "f", {"x": 7}, []))),
        (1, 1, "tool", result("a", "first")),
        (1, 1, "tool", result("a", "second")),
        (1, 1, "tool", result("a", "second")),
        (2, 0, "assistant", json.dumps({"content": "let me see", "tool_calls": [{"id": "p", "name": "g", "arguments": {}, "depends_on": []}]})),
        (2, 1, "assistant", json.dumps({"content": "none", "tool_calls": []})),
        (2, 2, "assistant", json.dumps({"content": None, "tool_calls": []})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id or 0, r.turn, r.place, r.kind, r.call_id or "", r.status, r.n_ignored), r.json) for r in tc.format_chat(df, SCHEMAS, duplicates=True).collect())
    assert [g[0] for g in got] == [
        (0, 0, 0, "call", "a", "no_result", 0),
        (0, 1, 0, "result", "a", "orphan_result", 0),
        (1, 0, 0, "call", "a", "duplicate", 0),
        (1, 0, 0, "call", "a", "ok", 3),
        (1, 0, 1, "call", "", "missing:gone", 0),
        (1, 0, 2, "call", "", "no_result", 0),
        (1, 1, 0, "result", "a", "duplicate", 0),
        (1, 1, 0, "result", "a", "duplicate", 0),
        (2, 0, -1, "message", "", "ok", 0),
        (2, 0, 0, "call", "p", "no_result", 0),
        (2, 1, -1, "message", "", "ok", 0),
        (2, 2, -1, "message", "", "ok", 0),
    ]
    texts = {g[0]: g[1] for g in got}
    assert texts[(1, 0, 0, "call", "a", "ok", 3)] == '{"arguments":{"x":7},"id":"a","name":"f","result":"first"}'
    assert texts[(1, 0, 0, "call", "a", "duplicate", 0)] == '{"arguments":{},"id":"a","name":"g","result":null}'
    assert texts[(1, 1, 0, "result", "a", "duplicate", 0)] == '{"content":"second","tool_call_id":"a"}'
    assert texts[(2, 0, -1, "message", "", "ok", 0)] == '{"content":"let me see","role":"assistant"}'


def test_the_query_keeps_turns_without_a_conversation_and_repeated_ones(spark, tmp_path):
    rows = [
        (None, 0, "user", "alone"),
        (None, 2, "user", "later"),
        (None, 3, "assistant", "said"),
        (1, 0, "user", "a"),
        (1, 0, "user", "b"),
        (1, 0, "user", "b"),
        (1, 1, "assistant", "c"),
        (1, 1, "assistant", "d"),
        (1, 2, "user", "e"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = tc.query(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id or 0, r.turn, r.kind, r.status, r.n_ignored) for r in got) == [
        (0, 0, "call", "no_result", 0),
        (0, 2, "call", "missing:t0", 0),
        (0, 3, "result", "orphan_result", 0),
        (1, 0, "call", "duplicate", 0),
        (1, 0, "call", "duplicate", 0),
        (1, 0, "call", "ok", 3),
        (1, 1, "result", "duplicate", 0),
        (1, 2, "call", "no_result", 0),
    ]
    assert sorted(word for r in got for word in ("alone", "later", "said", "a", "b", "c", "d", "e") if f':"{word}"' in r.json) == ["a", "alone", "b", "b", "c", "d", "e", "later", "said"]


def test_a_conversation_in_parts_is_numbered_through(spark):
    rows = [(c, t, "user", f"text {t % 3}") for c in (None, 1, 2) for t in range(400 if c == 1 else 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = tc.numbered(tc.format_chat(df))
    assert sorted((r.conv_id or 0, r.turn, r.seq) for r in got.collect()) == [(c or 0, t, t + 1) for c, t, _, _ in rows]


def test_the_query_meets_every_kind_of_call(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"words {t}") for c in range(30) for t in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = tc.query(spark, str(tmp_path)).collect()
    kinds = {r.status.split(":")[0] + ":" + r.status.split(":")[1] if r.status.startswith("invalid") else r.status.split(":")[0] for r in got}
    assert kinds >= {"ok", "cycle", "missing", "duplicate", "invalid:type", "invalid:missing", "invalid:unknown", "invalid:unknown_tool"}
    assert {0, 1, None} <= {r.level for r in got} and len(got) == 30 * 4 + sum(r.status == "duplicate" for r in got)


def test_white_space_before_a_tool_message(spark):
    df = spark.createDataFrame([(1, 0, "assistant", ' \n{ "content": null, "tool_calls": [{"id": "a", "name": "g", "arguments": {}}]}'), (1, 1, "tool", '\t{"content": 5, "tool_call_id": "a"}')], "conv_id long, turn long, role string, text string")
    for rows in (tc.format_chat(df, SCHEMAS), tc.format_chat(tc.as_tool_messages(df), SCHEMAS)):
        assert [(r.kind, r.status, r.json) for r in rows.collect()] == [("call", "ok", '{"arguments":{},"id":"a","name":"g","result":5}')]
