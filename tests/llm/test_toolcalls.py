import json

from sigflow.llm import toolcalls as T

SCHEMAS = {"add": {"a": ("BIGINT", True, 0, 9), "note": ("STRING", False, None, 5), "ok": ("BOOLEAN", False, None, None)}}
CALLS = [  # conv_id, call_id, after, name, arguments, turn
    (1, "x", None, "add", '{"note":"é\\"", "a": 1}', 0), (1, "y", "x", "add", '{"a":2,"ok":true}', 1),
    (1, "z", "y", "add", '{"a":3}', 2), (1, "z", None, "add", '{"a":4}', 3), (1, "u", "gone", "other", "{}", 4),
    (2, "x", None, "add", '{"a":10}', 0), (2, "b", None, "add", "[1]", 1), (2, "c", None, "add", "{bad", 2),
    (2, "d", None, "add", '{"note":"too long","q":1}', 3), (2, "e", "f", "add", '{"a":1}', 4), (2, "f", "e", "add", '{"a":1}', 5),
    (2, "g", "e", "add", '{"a":"1"}', 6), (3, None, None, "add", '{"a":1}', 0), (None, "x", None, "add", None, 0),
    (4, "p", None, None, '{"a":1}', None), (4, "q", None, "add", '{"a":null}', 0)]
RESULTS = [(1, "x", "one", 5), (1, "x", "again", 6), (1, "y", None, 7), (2, "x", "r", 8), (9, "lost", "r", 9), (None, "x", "n", 1),
           (2, "e", "r", 9), (2, "f", "r", 9)]


def frames(spark, calls=CALLS, results=RESULTS):
    return (spark.createDataFrame([(*c, 0) for c in calls], "conv_id long, call_id string, after string, name string, "
                                  "arguments string, turn long, depth int"),
            spark.createDataFrame([(*r, 0) for r in results], "conv_id long, call_id string, content string, turn long, status int"))


def test_statuses(spark):
    got = T.link_tool_calls(*frames(spark), SCHEMAS).collect()
    assert len(got) == len(CALLS) + 3                    # again, lost, NULL conversation
    have = {(r.conv_id, r.call_id, r.turn): (r.status, r.depth, list(r.errors)) for r in got}
    assert have[1, "x", 0] == ("ok", 0, []) and have[1, "y", 1] == ("ok", 1, []) and have[1, "z", 2] == ("unanswered", 2, [])
    assert have[1, "z", 3][0] == "duplicate_call" and have[1, "u", 4][:2] == ("unknown_tool", 0)
    assert have[2, "x", 0] == ("invalid_arguments", 0, ["range a"])
    assert have[2, "b", 1][0] == have[2, "c", 2][0] == "bad_json"
    assert have[2, "d", 3] == ("invalid_arguments", 0, ["missing a", "range note", "unknown q"])
    assert have[2, "e", 4][:2] == have[2, "f", 5][:2] == ("cyclic", None)
    assert have[2, "g", 6] == ("invalid_arguments", None, ["type a"])
    assert have[3, None, 0][0] == have[None, "x", 0][0] == "no_identifier"
    assert have[4, "p", None][0] == "unknown_tool" and have[4, "q", 0] == ("invalid_arguments", 0, ["type a"])
    assert have[1, "x", 6][0] == "extra_result" and have[9, "lost", 9][0] == "orphan_result"
    text = next(r.json for r in got if (r.conv_id, r.call_id, r.turn) == (1, "x", 0))
    assert text == ('{"arguments":{"a":1,"note":"é\\""},"conversation":1,"errors":[],"id":"x","name":"add","result":"one",'
                    '"status":"ok"}')
    for r in got:
        d = json.loads(r.json)
        assert json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_long_chain_and_star(spark):
    calls = [(1, f"c{i}", f"c{i - 1}", "add", '{"a":1}', i) for i in range(70)] + [
        (1, f"s{i}", "c0", "add", '{"a":1}', 100 + i) for i in range(20)]
    got = T.link_tool_calls(*frames(spark, calls, [(0, "none", "", 0)]), SCHEMAS).collect()
    have = {r.call_id: r.depth for r in got}
    assert all(have[f"c{i}"] == i for i in range(70)) and all(have[f"s{i}"] == 1 for i in range(20))


def test_empty_tables(spark):
    calls, results = frames(spark)
    assert T.link_tool_calls(calls.limit(0), results.limit(0), SCHEMAS).collect() == []
