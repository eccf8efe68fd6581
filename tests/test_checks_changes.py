from pulseframe.operators.changes import change_alerts, snapshot_diff
from pulseframe.operators.checks import check, fk_orphans, in_domain, in_range, key_violations, not_null
from pulseframe.sources.activity_lines import parse_activity
from pulseframe.sources.messages import decode_envelopes, encode_envelopes, explode_envelopes


def test_check_rules(spark):
    df = spark.createDataFrame([(1, "a", 17, "M"), (2, None, 30, "X"), (3, "c", None, "F")],
                               "id int, name string, age int, g string")
    r = dict(check(df, [not_null("name"), in_range("age", 18, 68), in_domain("g", ["M", "F"])]).collect())
    assert r == {"not_null:name": 1, "range:age": 1, "domain:g": 1}


def test_keys_and_fk(spark):
    u = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id int, e string")
    assert sorted((repr(r[0]), r[1]) for r in key_violations(u, ["id"]).collect()) == [("1", 2), ("None", 1)]
    posts = spark.createDataFrame([(10, 1), (11, 5), (12, None)], "pid int, user_id int")
    assert [r["pid"] for r in fk_orphans(posts, u, "user_id", "id").collect()] == [11]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, v string")
    r = {x["k"]: x["operation"] for x in snapshot_diff(old, new, ["k"]).collect()}
    assert r == {1: "DELETE", 2: "UPDATE", 4: "INSERT"}


def test_change_alert_text(spark):
    df = spark.createDataFrame([('{"table": "users", "operation": "UPDATE", "old_data": {"id": 1}, "new_data": {"id": 2}}',)],
                               "payload string")
    r = change_alerts(df).collect()[0]
    assert r["subject"] == "Changes in users table"
    assert r["body"] == 'Operation: UPDATE\nOld Data: {"id":1}\nNew Data: {"id":2}'


def test_parse_lines_keeps_rest_of_line(spark):
    line = '"2024-01-01 00:00:00";7;db;app;u;c;1.5;2;3;4;5;Y;N;active;"SELECT 1; SELECT 2"'
    df = spark.createDataFrame([(line,), ("a;b",)], "line string")
    good, bad = parse_activity(df)
    g = good.collect()[0]
    assert g["query"] == "SELECT 1; SELECT 2" and g["pid"] == 7 and g["cpu"] == 1.5
    assert [r["line"] for r in bad.collect()] == ["a;b"]


def test_envelope_round_trip(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "z", 3.0)], "snap int, ctx string, v double")
    msgs = encode_envelopes(df, "pg_stat_context_io", ["snap"], ["ctx", "v"])
    assert msgs.count() == 2
    back = explode_envelopes(decode_envelopes(msgs, "ctx STRING, v DOUBLE"))
    assert sorted((r["ctx"], r["v"]) for r in back.collect()) == [("x", 1.0), ("y", 2.0), ("z", 3.0)]


def test_large_snapshot_split_into_bounded_messages(spark):
    df = spark.createDataFrame([(1, f"c{i}", float(i)) for i in range(7)] + [(2, "z", 9.0)],
                               "snap int, ctx string, v double")
    msgs = encode_envelopes(df, "pg_stat_context_io", ["snap"], ["ctx", "v"], max_rows_per_message=2)
    decoded = decode_envelopes(msgs, "ctx STRING, v DOUBLE")
    sizes = [len(r["data"]) for r in decoded.collect()]
    assert sum(sizes) == 8 and len(sizes) >= 5
    back = explode_envelopes(decoded)
    assert sorted(r["ctx"] for r in back.collect()) == sorted([f"c{i}" for i in range(7)] + ["z"])


def test_activity_line_stream(spark, tmp_path):
    import os
    from pulseframe.streaming import activity_line_stream, run_available
    land = tmp_path / "landing"
    land.mkdir()
    lines = ['"2024-01-01 00:00:00";7;db;app;u;c;1.5;2;3;4;5;Y;N;active;"SELECT 1; SELECT 2"', "bad;line"]
    (land / "f1.txt").write_text("\n".join(lines) + "\n")
    good, rejected = activity_line_stream(spark, str(land))
    out = run_available(good, "append", "test-lines").collect()
    assert len(out) == 1 and out[0]["query"] == "SELECT 1; SELECT 2" and out[0]["pid"] == 7
    assert os.path.isdir(land)
