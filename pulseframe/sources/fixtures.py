"""Fixture tables derived from the driver's test tables.

Each fixture is one SQL SELECT over a base table, written in the subset of
SQL that Spark and DuckDB read alike (ASCII, explicit casts, every column
aliased). Spark builds the fixture with ``selectExpr`` over the parquet scan,
so filters and column pruning still reach the scan; the oracle side puts the
same text in a ``WITH`` clause.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Query texts of the activity fixture, one per event type.
_QUERY_CASE = (
    "CASE event_type "
    "WHEN 'click' THEN concat('SELECT * FROM users WHERE id = ', cast(user_id AS string)) "
    "WHEN 'view' THEN 'select u.id, p.title from users u JOIN posts p ON p.user_id = u.id' "
    "WHEN 'purchase' THEN concat('INSERT INTO posts VALUES (', cast(user_id % 4 AS string), ')') "
    "WHEN 'signup' THEN 'SELECT id FROM users WHERE id IN (SELECT user_id FROM posts)' "
    "ELSE 'SELECT id FROM users UNION SELECT user_id FROM posts' END"
)

_STATE_CASE = (
    "CASE event_type WHEN 'view' THEN 'idle' "
    "WHEN 'signup' THEN 'idle in transaction' ELSE 'active' END"
)


def _size_text(n: str, key: str) -> str:
    return (
        f"CASE {key} % 6 "
        f"WHEN 0 THEN concat(cast({n} AS string), ' bytes') "
        f"WHEN 1 THEN concat(cast({n} AS string), ' kB') "
        f"WHEN 2 THEN concat(cast({n} AS string), ' MB') "
        f"WHEN 3 THEN concat(cast({n} AS string), ' GB') "
        "WHEN 4 THEN '' ELSE 'junk' END"
    )


@dataclass(frozen=True)
class Fixture:
    base: str
    columns: tuple  # (expression, alias)
    where: str | None = None

    def sql(self) -> str:
        cols = ",\n       ".join(f"{e} AS {a}" for e, a in self.columns)
        text = f"SELECT {cols}\nFROM {self.base}"
        if self.where:
            text += f"\nWHERE {self.where}"
        return text


_ACTIVITY_COLS = (
    ("event_id", "event_id"),
    ("ts", "datetimeutc"),
    ("user_id", "pid"),
    ("concat('db', cast(user_id % 3 AS string))", "database_name"),
    ("event_type", "appname"),
    ("concat('u', cast(user_id % 10 AS string))", "user_name"),
    ("concat('10.0.0.', cast(user_id % 7 AS string))", "client"),
    ("value", "cpu"),
    ("cast((event_id * 7919) % 1000 AS double) / 10", "memory"),
    ("cast((event_id * 104729) % 10000 AS double) / 10", "read_io"),
    ("cast((event_id * 1299709) % 10000 AS double) / 10", "write_io"),
    ("cast((event_id * 15485863) % 1000 AS double) / 100", "duration"),
    ("CASE WHEN user_id % 5 = 0 THEN 'Y' ELSE 'N' END", "wait"),
    ("CASE WHEN event_type IN ('error', 'purchase') THEN 'Y' ELSE 'N' END", "io_wait"),
    (_STATE_CASE, "state"),
    (_QUERY_CASE, "query"),
)

# Dirty wire form: every field text, one `;`-joined line per sample. The
# query text is last and may itself contain `;` (purchase rows get a
# trailing `; COMMIT`), and every 97th cpu value is junk.
_RAW_CPU = "CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE cast(value AS string) END"
_RAW_QUERY = (
    f"CASE WHEN event_type = 'purchase' THEN concat({_QUERY_CASE}, '; COMMIT') "
    f"ELSE {_QUERY_CASE} END"
)
_RAW_DURATION = "cast((event_id * 15485863) % 1000 AS string)"
_RAW_LINE = (
    "CASE WHEN event_id % 89 = 0 THEN concat('\"', cast(event_id AS string), '\";short') "
    "ELSE concat_ws(';', "
    "concat('\"', cast(ts AS string), '\"'), cast(user_id AS string), "
    "concat('db', cast(user_id % 3 AS string)), event_type, "
    "concat('u', cast(user_id % 10 AS string)), concat('10.0.0.', cast(user_id % 7 AS string)), "
    f"{_RAW_CPU}, cast((event_id * 7919) % 1000 AS string), "
    "cast((event_id * 104729) % 10000 AS string), cast((event_id * 1299709) % 10000 AS string), "
    f"{_RAW_DURATION}, "
    "CASE WHEN user_id % 5 = 0 THEN 'Y' ELSE 'N' END, "
    "CASE WHEN event_type IN ('error', 'purchase') THEN 'Y' ELSE 'N' END, "
    f"{_STATE_CASE}, concat('\"', {_RAW_QUERY}, '\"')) END"
)

FIXTURES: dict[str, Fixture] = {
    "activity": Fixture("events", _ACTIVITY_COLS),
    "activity_raw": Fixture("events", (
        ("event_id", "event_id"),
        ("cast(ts AS string)", "datetimeutc"),
        ("cast(user_id AS string)", "pid"),
        (_RAW_CPU, "cpu"),
        ("cast((event_id * 7919) % 1000 AS string)", "memory"),
        (_RAW_DURATION, "duration"),
        (_RAW_LINE, "line"),
    )),
    "stat_io": Fixture("lineitem", (
        ("l_orderkey", "l_orderkey"),
        ("l_linenumber", "l_linenumber"),
        ("CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'N' THEN 'vacuum' ELSE 'bulkread' END", "context"),
        ("CASE WHEN l_linestatus = 'O' THEN 'client backend' ELSE 'checkpointer' END", "backend_type"),
        ("l_quantity", "reads"),
        ("cast(l_linenumber AS double)", "writes"),
        ("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END", "writebacks"),
    )),
    "user_tables": Fixture("part", (
        ("p_partkey", "snapshot_id"),
        ("p_brand", "schemaname"),
        ("concat('t', cast(p_partkey % 97 AS string))", "table_name"),
        (_size_text("p_size", "p_partkey"), "total_size"),
        (_size_text("p_size * 3", "(p_partkey + 1)"), "table_size"),
        (_size_text("p_size * 2", "(p_partkey + 2)"), "indexes_size"),
        ("cast(p_size AS bigint)", "sequential_scans"),
        ("cast(p_size % 7 AS bigint)", "index_scans"),
    )),
    "stat_activity": Fixture("events", (
        ("event_id", "event_id"),
        ("ts", "query_start"),
        ("user_id", "pid"),
        ("concat('db', cast(user_id % 3 AS string))", "datname"),
        ("CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('10.0.0.', cast(user_id % 7 AS string)) END", "client_addr"),
        ("CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('u', cast(user_id % 10 AS string)) END", "usename"),
        ("CASE WHEN user_id % 2 = 0 THEN 'client backend' ELSE 'autovacuum worker' END", "backend_type"),
        (_STATE_CASE, "state"),
        (_QUERY_CASE, "query"),
    )),
    "orders_old": Fixture("orders", (
        ("o_orderkey", "o_orderkey"),
        ("o_custkey", "o_custkey"),
        ("o_orderstatus", "o_orderstatus"),
        ("o_totalprice", "o_totalprice"),
    ), where="o_orderkey % 10 <> 0"),
    "orders_new": Fixture("orders", (
        ("o_orderkey", "o_orderkey"),
        ("o_custkey", "o_custkey"),
        ("CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END", "o_orderstatus"),
        ("o_totalprice", "o_totalprice"),
    ), where="o_orderkey % 10 <> 1"),
    "change_events": Fixture("orders", (
        ("o_orderkey", "event_id"),
        ("'orders'", "table_name"),
        ("CASE o_orderkey % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END", "operation"),
        ("concat('{\"table\": \"orders\", \"operation\": \"', "
         "CASE o_orderkey % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END, "
         "'\", \"old_data\": ', "
         "CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('{\"o_orderkey\": ', cast(o_orderkey AS string), "
         "', \"o_orderstatus\": \"', o_orderstatus, '\"}') END, "
         "', \"new_data\": ', "
         "CASE WHEN o_orderkey % 3 = 2 THEN 'null' ELSE concat('{\"o_orderkey\": ', cast(o_orderkey AS string), "
         "', \"o_orderstatus\": \"', o_orderpriority, '\"}') END, '}')", "payload"),
    )),
    # Constraint fixture: users = customer, posts = orders (SURVEY D-rows).
    "users": Fixture("customer", (
        ("c_custkey", "id"),
        ("c_name", "username"),
        ("CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(lower(c_name), '@example.org') END", "email"),
        ("c_mktsegment", "firstname"),
        ("cast(18 + (c_custkey * 31) % 60 AS int)", "age"),
        ("CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE 'X' END", "gender"),
    ), where="c_custkey % 9 <> 0"),
    "posts": Fixture("orders", (
        ("o_orderkey", "id"),
        ("o_custkey", "user_id"),
        ("o_orderpriority", "title"),
        ("o_orderstatus", "content"),
        ("o_orderdate", "created_at"),
    )),
}


def fixture_sql(name: str) -> str:
    return FIXTURES[name].sql()


def with_fixtures(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle SQL."""
    parts = [f"{n} AS (\n{fixture_sql(n)}\n)" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture ``name`` from the parquet tables under ``sf_dir``."""
    fx = FIXTURES[name]
    df = base_table(spark, sf_dir, fx.base)
    if fx.where:
        df = df.where(fx.where)
    return df.selectExpr(*[f"{e} AS {a}" for e, a in fx.columns])


def apply_fixture(df: DataFrame, name: str) -> DataFrame:
    """Derive fixture ``name`` from a (batch or streaming) base-table frame."""
    fx = FIXTURES[name]
    if fx.where:
        df = df.where(fx.where)
    return df.selectExpr(*[f"{e} AS {a}" for e, a in fx.columns])


def fixture_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Fixture ``name`` over a file stream of its base table's parquet files
    (schema taken from the batch table, never inferred on the stream)."""
    fx = FIXTURES[name]
    path = f"{sf_dir.rstrip('/')}/{fx.base}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return apply_fixture(r.parquet(stream_glob(path)), name)


def stream_glob(path: str) -> str:
    """A file stream source takes a folder or a glob, not a single file: a
    one-file path is turned into a glob matching exactly that file."""
    return path[:-1] + "[" + path[-1] + "]"
