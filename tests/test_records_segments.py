import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.rollups import latest_snapshot
from pulseframe.operators.windows import backfill, backfill_ranges
from pulseframe.sources.activity_lines import read_activity_records, record_lines
from pulseframe.sources.messages import (complete_rows, decode_envelopes, decode_snapshots, encode_envelopes, encode_snapshots,
                                         explode_envelopes, snapshot_status)

HEAD = "datetimeutc;pid;database_name;appname;user_name;client;cpu;memory;read_io;write_io;duration;wait;io_wait;state;query"
ROW = '"2024-01-01 00:00:0{i}";{i};db;app;u;10.0.0.1;1.5;2;3;4;5;N;N;active;'


def read(spark, folder, text, **kw):
    (folder / "f.csv").write_text(text)
    good, bad = read_activity_records(spark, str(folder), **kw)
    return {r["pid"]: r["query"] for r in good.collect()}, sorted(r["line"] for r in bad.collect())


def test_quotes_breaks_and_separators(spark, tmp_path):
    queries = ['"say ""hi"""', '"a;b;c"', "select 1; commit", '"line\nbreak;\n""x"""', '""', "", 'it "s', '"a";"b"']
    want = ['say "hi"', "a;b;c", "select 1; commit", 'line\nbreak;\n"x"', "", "", 'it "s']
    text = "\n".join([HEAD, *(ROW.format(i=i) + q for i, q in enumerate(queries[:6]))]) + "\n\n"
    assert read(spark, tmp_path, text) == (dict(enumerate(want[:6])), [])


def test_stray_quotes_and_short_lines(spark, tmp_path):
    lines = [HEAD, ROW.format(i=0) + 'it "s', ROW.format(i=1) + "plain", "short;line", ROW.format(i=2) + '"never closed', ROW.format(i=3) + "last"]
    got, bad = read(spark, tmp_path, "\n".join(lines))
    assert {1, 3} <= set(got) and got[1] == "plain" and got[3] == "last" and bad == ["short;line"]


@pytest.mark.parametrize("size", ["64b", "200b", "1m"])
def test_records_over_splits(spark, tmp_path, size):
    queries = [f'"q{i}\n{"z" * (i * 13 % 70)}\n;""{i}"""' if i % 3 else f"plain {i}" for i in range(60)]
    (tmp_path / "a.csv").write_text("\n".join([HEAD, *(ROW.format(i=i) + q for i, q in enumerate(queries))]) + "\n")
    (tmp_path / "b.csv").write_text(HEAD + "\n" + ROW.format(i=999) + "x\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        good, bad = read_activity_records(spark, str(tmp_path))
        got = {r["pid"]: r["query"] for r in good.collect()}
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {**{i: q[1:-1].replace('""', '"') if i % 3 else q for i, q in enumerate(queries)}, 999: "x"}


def test_unclosed_quote_does_not_swallow_the_file(spark, tmp_path):
    lines = [HEAD, ROW.format(i=0) + '"open', *(ROW.format(i=i) + "x" for i in range(1, 40))]
    got, bad = read(spark, tmp_path, "\n".join(lines), max_lines=10)
    assert len(got) == 40 and bad == []
    assert record_lines(spark, str(tmp_path), 10).agg(F.max(F.size("lines"))).first()[0] <= 10
    (tmp_path / "f.csv").write_text("")
    assert [x.count() for x in read_activity_records(spark, str(tmp_path))] == [0, 0]


# Messages

def rows(spark):
    return spark.createDataFrame([(None if i % 4 == 0 else "a" if i % 4 < 3 else "b", i, None if i == 5 else float(i)) for i in range(100)], "k string, id long, v double").repartition(7)


def test_chunks_tell_their_place(spark):
    m = encode_snapshots(rows(spark), "t", ["k"], ["id", "v"], 10).collect()
    df = spark.createDataFrame(m + m[:3])  # some delivered twice
    d = decode_snapshots(df, "id LONG, v DOUBLE")
    assert sorted((r["chunks"], r["received"], r["rows"], r["complete"]) for r in snapshot_status(d).collect()) == [(3, 3, 25, True), (3, 3, 25, True), (5, 5, 50, True)]
    assert sorted(r["id"] for r in complete_rows(d).collect()) == list(range(100))
    assert d.agg(F.max(F.size("data"))).first()[0] == 10 and len({r["key"] for r in m}) == 3
    # A lost chunk: its snapshot is not complete, the others are.
    lost = decode_snapshots(spark.createDataFrame(m[1:]), "id LONG, v DOUBLE")
    assert snapshot_status(lost).where("complete").count() == 2 and complete_rows(lost).count() in (50, 75)


def test_envelopes_keep_null_keys(spark):
    m = encode_envelopes(rows(spark), "t", ["k"], ["id", "v"], 30)
    assert m.count() == 4 and sorted(r["id"] for r in explode_envelopes(decode_envelopes(m, "id LONG, v DOUBLE")).collect()) == list(range(100))
    assert encode_snapshots(rows(spark).limit(0), "t", ["k"], ["id"]).count() == 0
    assert encode_snapshots(rows(spark), "t", [], ["id"], 1000).count() == 1


# Back fill and latest rows

@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_backfill_ranges_equals_pandas(spark, ranges):
    data = [(None if i % 50 < 30 else "hot" if i % 7 else "b", i * i, float(i) if i % 6 == 5 and i < 180 else None, "x" if i % 11 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(data, "k string, id long, v double, w string").repartition(5)
    got = backfill_ranges(df, ["v", "w"], ["k"], ["id"], ranges).orderBy("id").collect()
    p = pd.DataFrame(data, columns=["k", "id", "v", "w"])
    want = p.groupby("k", dropna=False)[["v", "w"]].bfill()
    assert [(r["v"], r["w"]) for r in got] == [(None if pd.isna(v) else v, None if pd.isna(w) else w) for v, w in zip(want["v"], want["w"])]
    for other in (backfill(df, ["v", "w"], ["k"], ["id"]), backfill(df, ["v", "w"], ["k"], ["id"], block=F.floor(F.col("id") / 500))):
        assert other.orderBy("id").collect() == got
    if ranges > 1:
        # The hot keys are filled in several pieces.
        assert backfill_ranges(df.limit(0), ["v"], ["k"], ["id"], ranges).count() == 0


def test_latest_snapshot_nulls_and_ties(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", None, 5), ("a", t, 1), ("a", t, 2), ("b", None, 7), ("b", None, None), (None, t, 3)], "k string, ts timestamp, v int")
    got = {r["k"]: (r["ts"], r["v"]) for r in latest_snapshot(df, ["k"], "ts").collect()}
    assert got == {"a": (t, 2), "b": (None, 7), None: (t, 3)}
