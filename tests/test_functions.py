import math
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulseframe.functions import (anomaly_labels, format_bytes, iso_text, normalize_query,
                                  parse_size_mb, query_shape, to_number)
from pulseframe.functions.labels import LABEL_RULES


def py_normalize(x: str) -> str:
    x = re.sub(r"[^a-zA-Z0-9\s]", "", x)
    x = x.lower()
    x = re.sub(r"\s+", " ", x)
    x = x.strip()
    x = re.sub(r"\d+", "NUM", x)
    x = re.sub(r"\b\w{1,2}\b", "", x)
    x = re.sub(r"\s+", " ", x)
    return x.strip()


def py_size(s):
    if s is None or s == "":
        return 0.0
    s = s.upper().strip()
    try:
        if s.endswith("MB"):
            return float(s.replace("MB", "").strip())
        if s.endswith("KB"):
            return float(s.replace("KB", "").strip()) / 1024
        if s.endswith("GB"):
            return float(s.replace("GB", "").strip()) * 1024
        if s.endswith("BYTES"):
            return float(s.replace("BYTES", "").strip()) / (1024 ** 2)
        return float(s.strip())
    except ValueError:
        return 0.0


def col_values(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


TEXT = st.lists(st.sampled_from(list("abcXYZ 019_;,.()*=\t\n\u00a0") + ["SELECT", " JOIN ", "id", "12"]),
                max_size=15).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_normalize_matches_python(spark, texts):
    assert col_values(spark, texts, normalize_query) == [py_normalize(t) for t in texts]


def test_normalize_not_idempotent(spark):
    once = col_values(spark, ["SELECT * FROM t WHERE id = 42"], normalize_query)[0]
    assert once == "select from where NUM"
    assert col_values(spark, [once], normalize_query)[0] == "select from where num"


SIZES = st.one_of(
    st.none(), st.just(""), st.just("junk"), st.just("5 TB"),
    st.builds(lambda n, u: f"{n}{u}", st.integers(0, 10 ** 6),
              st.sampled_from([" bytes", " kB", " MB", " GB", "MB", " kb", "", " Bytes"])))


@settings(max_examples=12, deadline=None)
@given(st.lists(SIZES, min_size=1, max_size=20))
def test_parse_size_matches_python(spark, sizes):
    got = col_values(spark, sizes, parse_size_mb)
    want = [py_size(s) for s in sizes]
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(got, want))


def test_parse_size_extended_units(spark):
    got = col_values(spark, ["5 TB"], lambda c: parse_size_mb(c, extended_units=True))
    assert got == [5.0 * 1024 * 1024]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 2 ** 52), min_size=1, max_size=20))
def test_format_bytes_round_trip(spark, values):
    pretty = col_values(spark, values, format_bytes, "long")
    back = col_values(spark, pretty, lambda c: parse_size_mb(c, extended_units=True))
    for v, p, mb in zip(values, pretty, back):
        if v < 10240:
            assert p == f"{v} bytes"
        # rounding to whole units: within half a unit (<= 2.5 % of the value)
        assert math.isclose(mb * 1024 * 1024, v, rel_tol=0.06, abs_tol=1.0), (v, p, mb)


def test_format_bytes_units(spark):
    vals = [0, 10239, 10240, 20479 * 512, 20480 * 1024, 10 * 1024 ** 3, 5 * 1024 ** 4, 3 * 1024 ** 5]
    got = col_values(spark, vals, format_bytes, "long")
    assert got == ["0 bytes", "10239 bytes", "10 kB", "10 MB", "20 MB", "10 GB", "5120 GB", "3072 TB"]


def test_format_bytes_beyond_bigint(spark, tmp_path):
    from pulseframe.plans import catalog
    keys = [(36_000_000, 1_200_000, 7), (1, 2, 3), (36_000_000, 400_000, 1), (None, 2, 3)]
    (spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet")))
    out = catalog.q_format_bytes(spark, str(tmp_path))
    assert dict(out.dtypes)["bytes"] == "bigint"
    got = {r["l_orderkey"]: (r["bytes"], r["pretty"]) for r in out.where("l_orderkey is null or l_linenumber <> 1").collect()}
    # 36e6 * 1.2e6^2 * 7 bytes are 322,302.18 PB.
    assert got == {36_000_000: (None, "322302 PB"), 1: (12, "12 bytes"), None: (None, None)}
    assert out.where("l_linenumber = 1").first()["bytes"] == 36_000_000 * 400_000 ** 2


def test_to_number_nan_and_junk(spark):
    got = col_values(spark, ["1.5", "n/a", "nan", None, " 7 "], to_number)
    assert got == [1.5, None, None, None, 7.0]


def test_iso_text(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.000123' b")
    r = df.select(iso_text("a"), iso_text("b")).collect()[0]
    assert tuple(r) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000123")


def test_query_shape(spark):
    df = spark.createDataFrame([("select a JOIN b join c JOIN d",), ("SELECT (select 1) UNION x",)], "query string")
    r = query_shape(df).collect()
    assert (r[0]["has_join"], r[0]["num_joins"], r[0]["query_complexity_score"]) == (1, 2, 2)
    assert (r[1]["has_subselect"], r[1]["has_union"], r[1]["query_complexity_score"]) == (1, 1, 5)


def py_labels(row):
    out = []
    conds = [row["is_high_cpu"] == 1, row["is_high_memory"] == 1, row["is_high_read"] == 1,
             row["is_high_write"] == 1, row["is_high_cpu_memory_ratio"] == 1,
             row["is_high_read_write_ratio"] == 1, row["is_high_cpu_duration_ratio"] == 1,
             row["is_high_memory_duration_ratio"] == 1, row["is_long_query"] == 1,
             row["wait"] == "Y" and row["is_long_query"] == 1,
             bool(row["is_high_cpu"]) and bool(row["is_high_memory"]), row["is_high_system_load"] == 1,
             row["is_high_io_wait"] == 1, row["has_join"] == 1, row["avg_io_wait_time"] > 10]
    for c, name in zip(conds, LABEL_RULES):
        if c:
            out.append(name)
    return ", ".join(out) if out else "Normal"


FLAGS = ["is_high_cpu", "is_high_memory", "is_high_read", "is_high_write", "is_high_cpu_memory_ratio",
         "is_high_read_write_ratio", "is_high_cpu_duration_ratio", "is_high_memory_duration_ratio",
         "is_long_query", "is_high_system_load", "is_high_io_wait", "has_join"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=len(FLAGS), max_size=len(FLAGS)),
                          st.sampled_from(["Y", "N"]), st.integers(0, 20)), min_size=1, max_size=25))
def test_labels_match_python(spark, rows):
    recs = [dict(zip(FLAGS, f), wait=w, avg_io_wait_time=c) for f, w, c in rows]
    schema = ", ".join(f"{f} int" for f in FLAGS) + ", wait string, avg_io_wait_time long"
    df = spark.createDataFrame([tuple(r[k] for k in FLAGS + ["wait", "avg_io_wait_time"]) for r in recs], schema)
    got = [r[0] for r in df.select(anomaly_labels()).collect()]
    assert got == [py_labels(r) for r in recs]


def test_drop_zone_and_text_columns(spark):
    from pulseframe.functions.casting import drop_zone
    from pulseframe.operators.encoding import text_columns
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS t, 'x' AS s, 1 AS i")
    r = df.select(drop_zone("t").alias("t")).collect()[0]["t"]
    assert str(r) == "2024-01-02 03:04:05"
    assert text_columns(df) == ["s"]


def test_long_pid_and_null_line(spark):
    from pulseframe.functions.casting import cast_activity
    from pulseframe.sources.activity_lines import split_activity_lines
    rows = spark.createDataFrame([("1e300",), ("9007199254740993",), ("12.0",), ("x",), (None,)], "pid string")
    assert [r["pid"] for r in cast_activity(rows).collect()] == [None, 9007199254740993, 12, None, None]
    good, bad = split_activity_lines(spark.createDataFrame([(None,), ("a;b",)], "line string"))
    assert good.count() == 0 and bad.count() == 2
