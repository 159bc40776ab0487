"""Operators as functions of plain tables: reading, joins, changes, the log, and programs over metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeframe.engine import Engine, median_key
from rangeframe.functions.keys import encode, key_column
from rangeframe.functions.types import Column, TableSchema, parse_create_table
from rangeframe.operators import access, joins, mutate, replay, routing
from rangeframe.plans import balance, cluster, migration, sql
from rangeframe.sources.catalog import Catalog
from rangeframe.sources.workspace import new_root, read_table
from rangeframe.suite.registry import query

ORDERS_DDL = """CREATE TABLE orders (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_totalprice DOUBLE,
    o_orderdate DATETIME, o_orderpriority VARCHAR(20), PRIMARY KEY (o_orderkey))"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders")


def orders_engine(spark: SparkSession, d: str, step: int = 5000) -> Engine:
    """An engine that holds orders in regions of ``step`` keys each, up to eight."""
    engine = Engine(spark, new_root(spark, "engine"))
    engine.create_table(ORDERS_DDL, [step * k for k in range(1, 8)], ("rs-1", "rs-2", "rs-3"))
    engine.load("orders", orders(spark, d))
    return engine


def money(c: F.Column | str) -> F.Column:
    """Sums of money are exact as decimals, then a double."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Range scan, filter and aggregates over region-partitioned orders."""
    rows = orders_engine(spark, d, 250).table("orders", 100, 1100)
    price = money("o_totalprice")
    return rows.agg(
        F.count("*").alias("n"), F.sum(price).cast("double").alias("total"), F.round(F.avg(price).cast("double"), 2).alias("average"),
        F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"),
    )


# Reading


@query("SELECT * FROM orders WHERE o_orderkey = 1234")
def point_get(spark, d):
    return access.get(orders(spark, d), "o_orderkey", 1234)


@query("""SELECT pos, key, o_orderkey IS NOT NULL AS found FROM (VALUES (0::BIGINT, 3::BIGINT), (1, 99999999), (2, 0), (3, 3), (4, -5)) k(pos, key)
    LEFT JOIN orders ON o_orderkey = key""")
def exists_keys(spark, d):
    return access.exists(orders(spark, d), "o_orderkey", [3, 99999999, 0, 3, -5])


@query("""SELECT pos, key, o_orderkey IS NOT NULL AS found, o_custkey, o_totalprice
    FROM (VALUES (0::BIGINT, 7::BIGINT), (1, 3), (2, -1), (3, 7), (4, 1400), (5, 123456789)) k(pos, key) LEFT JOIN orders ON o_orderkey = key""")
def batch_get(spark, d):
    return access.batch_get(orders(spark, d), "o_orderkey", [7, 3, -1, 7, 1400, 123456789], ["o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000 ORDER BY o_orderkey")
def range_scan(spark, d):
    return access.scan(orders(spark, d), "o_orderkey", 1000, 2000, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1200 ORDER BY o_orderkey DESC LIMIT 25")
def reverse_scan_limit(spark, d):
    return access.scan(orders(spark, d), "o_orderkey", None, 1200, ["o_orderkey", "o_totalprice"], limit=25, reverse=True)


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 12000
    AND o_orderstatus = 'F' AND o_totalprice > 200000 ORDER BY o_orderkey""")
def scan_filter_project(spark, d):
    return access.scan(orders(spark, d), "o_orderkey", 100, 12000, ["o_orderkey", "o_orderpriority"], "o_orderstatus = 'F' AND o_totalprice > 200000")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 500")
def empty_range(spark, d):
    return access.scan(orders(spark, d), "o_orderkey", 500, 500, ["o_orderkey"])


@query("SELECT count(*) AS count FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 9000 AND o_orderpriority LIKE '1%'")
def range_count(spark, d):
    return access.query(orders(spark, d), "o_orderkey", access.Query("count", 100, 9000, "o_orderpriority LIKE '1%'"))


def _aggregate(name: str, function: str, digits: int = 2):
    inner = f"{function}(CAST(o_totalprice AS DECIMAL(18,2)))" if function in ("SUM", "AVG") else f"{function}(o_totalprice)"

    def run(spark, d):
        exact = orders(spark, d).withColumn("o_totalprice", money("o_totalprice"))
        request = access.Query("aggregate", 1000, 9000, None, function, "o_totalprice")
        return access.query(exact, "o_orderkey", request).withColumn("value", F.round("value", digits))

    run.__name__ = name
    query(f"SELECT round(CAST({inner} AS DOUBLE), {digits}) AS value, count(o_totalprice) AS count FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000")(run)


for _f in ("SUM", "AVG", "MIN", "MAX"):
    _aggregate(f"range_{_f.lower()}", _f)


@query("SELECT CAST(NULL AS DOUBLE) AS value, CAST(0 AS BIGINT) AS count")
def aggregate_empty(spark, d):
    return access.aggregate(orders(spark, d), "o_orderkey", "AVG", "o_totalprice", -9, -3)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 40")
def filter_query(spark, d):
    request = access.Query("filter", filter="c_acctbal < 0 AND c_mktsegment = 'BUILDING'", columns=("c_custkey", "c_name", "c_acctbal"), limit=40)
    return access.query(read_table(spark, d, "customer"), "c_custkey", request)


def _bounds() -> list[tuple[bytes, bytes, str]]:
    edges = [None, 1000, 2500, 4000, 9000, None]
    return [(encode(a), encode(b), f"orders-{k}") for k, (a, b) in enumerate(zip(edges, edges[1:]))]


_REGION_OF = """CASE WHEN o_orderkey < 1000 THEN 'orders-0' WHEN o_orderkey < 2500 THEN 'orders-1' WHEN o_orderkey < 4000 THEN 'orders-2'
    WHEN o_orderkey < 9000 THEN 'orders-3' ELSE 'orders-4' END"""


def _routed(spark, d):
    return routing.with_region(orders(spark, d), "o_orderkey", T.LongType(), _bounds())


@query(f"""SELECT {_REGION_OF} AS region_id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
    min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def region_partials(spark, d):
    rows = _routed(spark, d).select("region_id", "o_totalprice", money("o_totalprice").alias("exact"))
    parts = access.partial_aggregates(rows, "region_id", "exact")
    return parts.select("region_id", "n", F.col("total").cast("double").alias("total"), F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"))


@query("""SELECT count(*) AS count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum,
    round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""")
def region_partial_agg(spark, d):
    rows = _routed(spark, d).select("region_id", money("o_totalprice").alias("exact"))
    one = access.combine_partials(access.partial_aggregates(rows, "region_id", "exact"))
    double = [F.col(c).cast("double").alias(c) for c in ("sum", "min", "max")]
    return one.select("count", *double, F.round(F.col("sum").cast("double") / F.col("count"), 2).alias("avg"))


# Joins and SQL


@query("SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def join_inner(spark, d):
    big = orders(spark, d).where("o_totalprice > 400000")
    return joins.equi_join(big, read_table(spark, d, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON o_custkey = c_custkey""")
def join_left(spark, d):
    big = orders(spark, d).where("o_totalprice > 450000")
    return joins.equi_join(read_table(spark, d, "customer"), big, [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("SELECT n_name, r_regionkey, r_name FROM (SELECT * FROM nation WHERE n_nationkey % 5 = 1) n RIGHT JOIN region ON n_regionkey = r_regionkey")
def join_right(spark, d):
    some = read_table(spark, d, "nation").where("n_nationkey % 5 = 1")
    return joins.equi_join(some, read_table(spark, d, "region"), [("n_regionkey", "r_regionkey")], "right").select("n_name", "r_regionkey", "r_name")


@query("SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 49")
def join_colocated(spark, d):
    root = new_root(spark, "buckets").rsplit("-", 1)[1][:12]
    names = f"orders_{root}", f"lineitem_{root}"
    joins.write_colocated(orders(spark, d), names[0], "o_orderkey", 8)
    joins.write_colocated(read_table(spark, d, "lineitem").where("l_quantity >= 49"), names[1], "l_orderkey", 8)
    return joins.colocated_join(spark, *names, "o_orderkey", "l_orderkey").select("o_orderkey", "l_partkey", "l_quantity")


@query("""SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000""")
def semi_reduced_join(spark, d):
    small = read_table(spark, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
    return joins.reduced_join(small, orders(spark, d), "c_custkey", "o_custkey").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 4990 AND 5010 ORDER BY o_orderkey")
def sql_between(spark, d):
    return sql.execute_query(orders_engine(spark, d), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 4990 AND 5010 ORDER BY o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777")
def sql_point(spark, d):
    return sql.execute_query(orders_engine(spark, d), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey = 12 THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey < 40 AND o_orderkey NOT IN (7, 30)
    UNION ALL SELECT -3, 9.25, 'N'""")
def sql_update(spark, d):
    engine = orders_engine(spark, d)
    sql.execute_update(engine, "INSERT INTO orders (o_orderkey, o_totalprice, o_orderstatus) VALUES (-3, 9.25D, 'N')")
    sql.execute_update(engine, "UPDATE orders SET o_totalprice = 1.5 WHERE o_orderkey = 12")
    sql.execute_update(engine, "DELETE FROM orders WHERE o_orderkey = 7")
    sql.execute_update(engine, "DELETE FROM orders WHERE o_orderkey > 29 AND o_orderkey <= 30")
    return sql.execute_query(engine, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey < 40")


# Catalog and routing

_USERS = TableSchema("users", (Column("user_id", "BIGINT", False), Column("username", "VARCHAR(50)", False), Column("email", "VARCHAR(100)")), "user_id")


def _catalog(spark: SparkSession) -> Catalog:
    c = Catalog(spark)
    c.create_table(_USERS, [b"m"], ("rs-1", "rs-2"))
    c.create_table(parse_create_table("CREATE TABLE orders (id BIGINT PRIMARY KEY, total DOUBLE DEFAULT 0 COMMENT 'sum')"), None, ("rs-1",))
    return c


@query("""SELECT * FROM (VALUES ('users', 0, 'user_id', 'BIGINT', false), ('users', 1, 'username', 'VARCHAR(50)', false),
    ('users', 2, 'email', 'VARCHAR(100)', true), ('orders', 0, 'id', 'BIGINT', false), ('orders', 1, 'total', 'DOUBLE', true)) t(table_name, pos, name, type, nullable)""")
def describe_tables(spark, d):
    return _catalog(spark).columns_frame().select("table_name", "pos", "name", "type", "nullable")


@query("""SELECT * FROM (VALUES ('orders-000000', 'orders', '', '', 'rs-1'), ('users-000000', 'users', '', 'm', 'rs-1'), ('users-000001', 'users', 'm', '', 'rs-2'))
    t(region_id, table_name, start_key, end_key, "primary")""")
def catalog_regions(spark, d):
    c = _catalog(spark)
    c.set_primary("users-000001", "rs-2")
    r = c.regions_frame()
    return r.select("region_id", "table_name", F.col("start_key").cast("string").alias("start_key"), F.col("end_key").cast("string").alias("end_key"), "primary")


@query("""SELECT * FROM (VALUES ('users', 'abc', 'users-000000'), ('users', 'xyz', 'users-000001'), ('users', 'm', 'users-000001'),
    ('orders', 'q', 'orders-000000'), ('none', 'q', NULL)) t(table_name, k, region_id)""")
def route_for_key(spark, d):
    keys = spark.createDataFrame([("users", "abc"), ("users", "xyz"), ("users", "m"), ("orders", "q"), ("none", "q")], "table_name string, k string")
    found = routing.route_for_key(_catalog(spark).regions_frame(), keys.withColumn("key", F.col("k").cast("binary")))
    return found.select("table_name", "k", "region_id")


@query("SELECT * FROM (VALUES ('a', 'users-000000'), ('a', 'users-000001'), ('n', 'users-000001'), ('c', 'users-000000')) t(low, region_id)")
def routes_for_range(spark, d):
    r = _catalog(spark).regions_frame()
    ranges = [("a", b"a", b"z"), ("n", b"n", b"o"), ("c", b"c", b"c")]
    parts = [routing.routes_for_range(r, "users", lo, hi).select(F.lit(n).alias("low"), "region_id") for n, lo, hi in ranges]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'fresh' AS status, region_id FROM (VALUES ('users-000000'), ('users-000001')) t(region_id) UNION ALL SELECT 'cached', NULL UNION ALL SELECT 'not_found', NULL")
def route_table(spark, d):
    c = _catalog(spark)
    out = None
    for name, version in (("users", 0), ("users", 99), ("none", 0)):
        status, found = routing.route_table(c.regions_frame(), c.tables_frame(), name, version)
        rows = spark.range(1).select(F.lit(status).alias("status"), F.lit(None).cast("string").alias("region_id")) if found is None else found.select(F.lit(status).alias("status"), "region_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT {_REGION_OF} AS region_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def route_rows(spark, d):
    return _routed(spark, d).groupBy("region_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT * FROM (VALUES ('b', 'overlap'), ('c', 'gap'), ('d', 'inverted')) t(region_id, problem)")
def layout_check(spark, d):
    rows = [("a", b"", b"f"), ("b", b"f", b"k"), ("c", b"j", b"p"), ("d", b"t", b"s"), ("e", b"x", b"")]
    frame = spark.createDataFrame([(i, "t", bytearray(s), bytearray(e)) for i, s, e in rows], "region_id string, table_name string, start_key binary, end_key binary")
    return routing.layout_problems(frame).select("region_id", "problem")


# Changing


def _changes(spark, d):
    c = read_table(spark, d, "customer")
    return c.where("c_custkey % 7 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"), F.col("c_acctbal") + 1)


@query("""WITH s AS (SELECT c_custkey * 2 AS k FROM customer WHERE c_custkey % 7 = 0), p AS (SELECT c_custkey * 2 AS k, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 7 = 0)
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM s) UNION ALL SELECT k, 'new', b FROM p""")
def put_upsert(spark, d):
    base = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return mutate.put(base, "c_custkey", _changes(spark, d).toDF("c_custkey", "c_name", "c_acctbal"))


@query("""SELECT c.c_custkey, CASE WHEN p.k IS NULL THEN c.c_name ELSE 'new' END AS c_name, c.c_mktsegment FROM customer c
    LEFT JOIN (SELECT c_custkey * 2 AS k FROM customer WHERE c_custkey % 7 = 0) p ON p.k = c.c_custkey
    UNION ALL SELECT c_custkey * 2, 'new', NULL FROM customer WHERE c_custkey % 7 = 0 AND c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""")
def put_partial(spark, d):
    base = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return mutate.put(base, "c_custkey", _changes(spark, d).select("c_custkey", "c_name"))


_CUSTOMER = TableSchema("customer", (Column("c_custkey", "BIGINT", False), Column("c_name", "VARCHAR(12)", False), Column("c_acctbal", "DOUBLE")), "c_custkey")


def _batch(spark, d):
    c = read_table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit("a name too long")).otherwise(F.lit("ok"))
    return c.select(F.col("c_custkey").alias("pos"), "c_custkey", name.alias("c_name"), F.lit(0.5).alias("c_acctbal"))


@query("""SELECT c_custkey AS pos, NOT (c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS ok,
    CASE WHEN c_custkey % 5 = 0 THEN 'column c_name is null' WHEN c_custkey % 7 = 0 THEN 'column c_name is longer than 12' END AS error,
    CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE 101 + c_custkey END AS sequence_id FROM customer""")
def batch_put_report(spark, d):
    base = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return mutate.batch_put(base, _CUSTOMER, _batch(spark, d), 100)[1]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'ok' ELSE c_name END AS c_name FROM customer""")
def batch_put_rows(spark, d):
    base = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return mutate.batch_put(base, _CUSTOMER, _batch(spark, d), 100)[0].select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey * 3 FROM customer)")
def delete_keys(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    return mutate.delete(c, "c_custkey", c.select((F.col("c_custkey") * 3).alias("c_custkey")))


@query("""SELECT * FROM (VALUES (0::BIGINT, 5::BIGINT, true, 11::BIGINT), (1, -1, false, 12), (2, 5, false, 13), (3, 0, true, 14)) t(pos, key, existed, sequence_id)""")
def batch_delete_report(spark, d):
    c = read_table(spark, d, "customer")
    return mutate.delete_report(c, "c_custkey", access.key_frame(c, "c_custkey", [5, -1, 5, 0]), 10)


@query("""SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM
    (SELECT CASE WHEN o_orderkey % 100 = 0 THEN 1.25 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 1000 <> 500)""")
def engine_merge_and_compact(spark, d):
    """Upserts and deletes through the log, flushed into the regions that they touch, then compacted."""
    engine = orders_engine(spark, d)
    keys = orders(spark, d).select("o_orderkey")
    engine.put_rows("orders", keys.where("o_orderkey % 100 = 0").withColumn("o_totalprice", F.lit(1.25)))
    engine.flush("orders")
    engine.delete_rows("orders", keys.where("o_orderkey % 1000 = 500"))
    engine.compact("orders")
    return engine.table("orders").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))


# The log

_LOG = ["sequence_id", "key", "op", "v"]


def _event_log(spark, d):
    e = read_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("sequence_id"), F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.col("value").alias("v"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("v"))).alias("present"),
    )


@query("""SELECT key, v, kind FROM (SELECT user_id AS key, value AS v, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
    WHERE rn = 1 AND kind <> 'error'""")
def wal_replay(spark, d):
    return replay.live(replay.replay(_event_log(spark, d), ["key"], ["v", "kind"]))


@query("""WITH l AS (SELECT event_id AS s, user_id AS key, value AS v, event_type AS kind, event_id % 3 = 0 AS part FROM events),
    g AS (SELECT key, max(CASE WHEN kind = 'error' THEN s ELSE -1 END) AS gone, max(s) AS last FROM l GROUP BY key),
    a AS (SELECT l.*, g.gone FROM l JOIN g USING (key) WHERE l.s > g.gone AND g.last > g.gone)
    SELECT key, arg_max(v, s) AS v, arg_max(kind, s) FILTER (NOT part) AS kind FROM a GROUP BY key""")
def wal_column_merge(spark, d):
    return replay.live(replay.replay(_event_log(spark, d), ["key"], ["v", "kind"], present="present"))


@query("SELECT event_id AS sequence_id, user_id AS key, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, value AS v FROM events WHERE event_id BETWEEN 100 AND 400 ORDER BY 1")
def wal_tail(spark, d):
    return replay.tail(_event_log(spark, d), 100, 400).select(*_LOG)


@query("SELECT count(*) FILTER (event_id > 250) AS applied_count, max(event_id) AS last_applied_sequence FROM events")
def wal_apply_summary(spark, d):
    return replay.apply_summary(_event_log(spark, d), 250)


@query("SELECT event_id AS sequence_id FROM events WHERE event_id % 97 = 0")
def wal_corrupt(spark, d):
    log = _event_log(spark, d).select(
        "sequence_id", F.lit("r").alias("region_id"), F.lit(0).cast("long").alias("ts"), "op",
        key_column("key", T.LongType()).alias("key"), F.create_map(F.lit("v"), F.col("v").cast("string").cast("binary")).alias("columns"),
    )
    broken = F.when(F.col("sequence_id") % 97 == 0, F.lit("DELETE?")).otherwise(F.col("op"))
    return replay.corrupt(replay.with_checksum(log).withColumn("op", broken)).select("sequence_id")


@query("""SELECT event_type AS region_id, max(event_id) - max(CASE WHEN event_id < 500 THEN event_id ELSE 0 END) AS lag,
    max(event_id) - max(CASE WHEN event_id < 500 THEN event_id ELSE 0 END) < 100 AS caught_up FROM events GROUP BY 1""")
def replication_lag(spark, d):
    log = _event_log(spark, d).select(F.col("kind").alias("region_id"), "sequence_id")
    return replay.lag(log, log.where("sequence_id < 500"))


# Regions


@query("SELECT o_orderkey AS split_key FROM orders ORDER BY o_orderkey OFFSET (SELECT count(*) // 2 FROM orders) LIMIT 1")
def region_split_median(spark, d):
    return spark.createDataFrame([(median_key(orders(spark, d).select("o_orderkey"), "o_orderkey"),)], "split_key long")


@query("SELECT CASE WHEN o_orderkey < 300 THEN 'left' ELSE 'right' END AS half, count(*) AS n FROM orders WHERE o_orderkey < 5000 GROUP BY 1")
def region_split(spark, d):
    engine = orders_engine(spark, d)
    a, b = engine.split_region("orders-000000", 300)
    sides = [engine._stored("orders", [r]).select(F.lit(n).alias("half")) for r, n in ((a, "left"), (b, "right"))]
    return sides[0].unionByName(sides[1]).groupBy("half").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderkey < 10000")
def region_merge(spark, d):
    engine = orders_engine(spark, d)
    merged = engine.merge_regions("orders-000000", "orders-000001")
    return engine._stored("orders", [merged]).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


def order_regions(spark, d):
    """Regions of 1,000 orders: a MiB for each order."""
    g = orders(spark, d).groupBy(F.floor(F.col("o_orderkey") / 1000).alias("k")).agg(F.count("*").alias("n"))
    state = F.when(F.col("k") % 4 == 3, "SPLITTING").when(F.col("k") % 5 == 4, "MIGRATING").otherwise("ONLINE")
    return g.select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("region_id"), F.lit("orders").alias("table_name"),
        (F.col("n") * 1048576).alias("size_bytes"), state.alias("state"), F.col("k").alias("k"),
    )


_ORDER_REGIONS = """(SELECT 'r' || k AS region_id, n * 1048576 AS size_bytes, CASE WHEN k % 4 = 3 THEN 'SPLITTING' WHEN k % 5 = 4 THEN 'MIGRATING' ELSE 'ONLINE' END AS state, k
    FROM (SELECT o_orderkey // 1000 AS k, count(*) AS n FROM orders GROUP BY 1))"""


@query(f"""SELECT CAST(1 AS BIGINT) AS tables, count(*) AS regions, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, round(avg(size_bytes) / 1048576.0, 6) AS avg_region_mib,
    count(*) FILTER (state = 'SPLITTING') AS splitting, count(*) FILTER (state = 'MIGRATING') AS migrating, CAST(sum(size_bytes) // 1048576 AS BIGINT) AS total_row_count,
    (SELECT CAST(sum(s_suppkey * 3) AS BIGINT) FROM supplier WHERE s_suppkey % 10 > 1) AS total_qps FROM {_ORDER_REGIONS}""")
def region_stats(spark, d):
    rows = order_regions(spark, d).withColumn("rows", (F.col("size_bytes") / 1048576).cast("long"))
    loaded = servers(spark, d).withColumn("qps", F.col("server_id").cast("long") * 3)
    return cluster.table_stats(rows, loaded).withColumn("avg_region_mib", F.round("avg_region_mib", 6))


# The cluster: suppliers stand for servers

NOW = datetime(2024, 1, 30)


def servers(spark, d):
    s = read_table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.cast("string").alias("server_id"), F.col("s_name").alias("host"), F.lit(8000).alias("port"),
        F.when(k % 10 == 0, "DEAD").when(k % 10 == 1, "OFFLINE").otherwise("ONLINE").alias("state"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(secs=k % 45)).alias("last_heartbeat"),
        (k % 7).cast("int").alias("region_count"), ((k % 5) * cluster.GIB).alias("total_size_bytes"),
        (k % 100).cast("double").alias("cpu_usage"), ((k * 7) % 100).cast("double").alias("memory_usage"),
    )


_SERVERS = """(SELECT CAST(s_suppkey AS VARCHAR) AS server_id, CASE WHEN s_suppkey % 10 = 0 THEN 'DEAD' WHEN s_suppkey % 10 = 1 THEN 'OFFLINE' ELSE 'ONLINE' END AS state,
    s_suppkey % 45 AS silent, s_suppkey % 7 AS region_count,
    0.5::DOUBLE * (s_suppkey % 7) + 0.3::DOUBLE * (s_suppkey % 5) + 0.1::DOUBLE * (s_suppkey % 100) + 0.1::DOUBLE * ((s_suppkey * 7) % 100) AS load FROM supplier)"""


@query(f"SELECT server_id, round(load, 6) AS load FROM {_SERVERS}")
def load_score(spark, d):
    return servers(spark, d).select("server_id", F.round(cluster.load_score(), 6).alias("load"))


@query(f"SELECT server_id, round(load, 6) AS load FROM {_SERVERS} WHERE state = 'ONLINE' ORDER BY round(load, 9), server_id LIMIT 1")
def least_loaded(spark, d):
    return cluster.least_loaded(servers(spark, d)).select("server_id", F.round("load", 6).alias("load"))


@query(f"SELECT server_id FROM {_SERVERS} WHERE state = 'ONLINE' AND silent > 30")
def heartbeat_timeouts(spark, d):
    return cluster.timed_out(servers(spark, d), NOW).select("server_id")


@query("SELECT user_id AS server_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_heartbeat(spark, d):
    beats = read_table(spark, d, "events").select(F.col("user_id").alias("server_id"), "ts", "event_type")
    return cluster.latest_heartbeats(beats).select("server_id", "ts")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS beat, * FROM supplier)
    SELECT CAST(k AS VARCHAR) AS server_id, s_name AS host, 8000 AS port, CASE WHEN k % 10 = 0 AND NOT beat THEN 'DEAD' WHEN k % 10 = 1 THEN 'OFFLINE' ELSE 'ONLINE' END AS state,
    epoch_ms(TIMESTAMP '2024-01-30') - CASE WHEN beat THEN 0 ELSE (k % 45) * 1000 END AS seen_ms, CAST(CASE WHEN beat THEN 99 ELSE k % 7 END AS BIGINT) AS region_count,
    CASE WHEN beat THEN 5 ELSE (k % 5) * 1073741824 END AS total_size_bytes, CASE WHEN beat THEN 12.5 ELSE CAST(k % 100 AS DOUBLE) END AS cpu_usage,
    CASE WHEN beat THEN 50.5 ELSE CAST((k * 7) % 100 AS DOUBLE) END AS memory_usage FROM s""")
def send_heartbeats(spark, d):
    s = servers(spark, d)
    beats = s.where(F.col("server_id").cast("int") % 3 == 0).select(
        "server_id", F.lit(NOW).cast("timestamp").alias("ts"), F.lit(99).alias("region_count"), F.lit(5).cast("long").alias("total_size_bytes"), F.lit(12.5).alias("cpu_usage"), F.lit(50.5).alias("memory_usage"),
        F.array(F.lit("x")).alias("region_ids"),
    )
    late = beats.withColumns({"ts": F.expr("ts - INTERVAL 1 HOUR"), "region_count": F.lit(1), "cpu_usage": F.lit(0.0)})
    none = spark.createDataFrame([], cluster.SERVER_REGIONS)
    out = cluster.apply_heartbeats(s, none, late.unionByName(beats))[0]
    return out.select("server_id", "host", "port", "state", F.unix_millis("last_heartbeat").alias("seen_ms"), F.col("region_count").cast("long").alias("region_count"), "total_size_bytes", "cpu_usage", "memory_usage")


@query(f"""SELECT count(*) AS total_servers, count(*) FILTER (state = 'ONLINE') AS online_servers, count(*) FILTER (state = 'DEAD') AS dead_servers,
    CAST(sum(region_count) AS BIGINT) AS total_regions FROM {_SERVERS}""")
def cluster_stats(spark, d):
    return cluster.cluster_stats(servers(spark, d))


def _replicas(spark, d):
    k = F.col("k")
    return order_regions(spark, d).withColumn("replicas", F.array(*[((k + i) % 10).cast("string") for i in (0, 1)]))


@query(f"""WITH r AS (SELECT region_id, state, unnest([CAST(k % 10 AS VARCHAR), CAST((k + 1) % 10 AS VARCHAR)]) AS replica FROM {_ORDER_REGIONS}),
    p AS (SELECT region_id, r.state, count(*) FILTER (s.state = 'ONLINE') AS up FROM r LEFT JOIN {_SERVERS} s ON s.server_id = replica GROUP BY ALL),
    a AS (SELECT count(*) FILTER (up = 0) AS lost_regions, count(*) FILTER (state <> 'ONLINE') AS unavailable_regions FROM p),
    b AS (SELECT count(*) FILTER (state = 'ONLINE') AS online_servers, count(*) FILTER (state = 'DEAD') AS dead_servers FROM {_SERVERS})
    SELECT CASE WHEN online_servers = 0 OR lost_regions > 0 THEN 'CRITICAL' WHEN dead_servers > 0 OR unavailable_regions > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status,
    online_servers, dead_servers, lost_regions, unavailable_regions FROM a, b""")
def cluster_health(spark, d):
    return cluster.cluster_health(servers(spark, d), _replicas(spark, d))


@query(f"""WITH RECURSIVE lost AS (SELECT s.server_id, r.region_id, row_number() OVER (ORDER BY s.server_id, r.region_id) AS i
        FROM {_ORDER_REGIONS} r JOIN {_SERVERS} s ON s.server_id = CAST(r.k % 14 + 31 AS VARCHAR) WHERE s.state = 'ONLINE' AND s.silent > 30),
    step(i, target, pool) AS (
        SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), list_sort(list({{'load': load, 'id': server_id}})) FROM {_SERVERS} WHERE state = 'ONLINE' AND silent <= 30
        UNION ALL SELECT i + 1, pool[1].id, list_sort(list_append(pool[2:], {{'load': pool[1].load + 0.5::DOUBLE, 'id': pool[1].id}})) FROM step WHERE i < (SELECT count(*) FROM lost))
    SELECT lost.server_id, lost.region_id, step.target FROM lost JOIN step USING (i)""")
def recovery_plan(spark, d):
    """Greedy reassignment of silent servers' regions: each choice depends on the ones before."""
    placed = order_regions(spark, d).select((F.col("k") % 14 + 31).cast("string").alias("server_id"), "region_id", "size_bytes")
    return cluster.recover(servers(spark, d), placed, NOW)[2]


@query("""SELECT * FROM (VALUES ('CORRUPTION', 'RESTORE_FROM_REPLICA'), ('REPLICA_SYNC_FAILED', 'RESTORE_FROM_REPLICA'), ('DISK_ERROR', 'REASSIGN'),
    ('UNKNOWN_ERROR', 'MARK_OFFLINE'), ('OTHER', 'NONE')) t(kind, action)""")
def recovery_actions(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("CORRUPTION", "REPLICA_SYNC_FAILED", "DISK_ERROR", "UNKNOWN_ERROR", "OTHER")], "kind string")
    return kinds.withColumn("action", cluster.recovery_action(F.col("kind")))


# Balancing and migrations


def _loads(spark, d):
    return servers(spark, d).withColumn("load", cluster.load_score())


@query(f"""WITH s AS (SELECT * FROM {_SERVERS} WHERE state = 'ONLINE'), a AS (SELECT avg(load) AS avg_load, min(load) AS least, count(*) AS n FROM s)
    SELECT coalesce(bool_or(n >= 2 AND s.load > avg_load * 1.5 AND s.region_count >= 2 AND s.load - least > avg_load * 0.3), false) AS needs_balance FROM s, a""")
def needs_balance(spark, d):
    return balance.needs_balance(_loads(spark, d)).select("needs_balance")


@query(f"""SELECT region_id, round(((3.0 - 2.0)^2 + (1.0 - 2.0)^2) - ((3.0 - (0.5 + 0.3 * g) - 2.0)^2 + (1.0 + (0.5 + 0.3 * g) - 2.0)^2) - 0.1 * g, 6) AS benefit
    FROM (SELECT region_id, size_bytes / 1073741824.0::DOUBLE AS g FROM {_ORDER_REGIONS})""")
def migration_benefit(spark, d):
    b = balance.benefit(F.lit(3.0), F.lit(1.0), F.col("size_bytes"), F.lit(2.0))
    return order_regions(spark, d).select("region_id", F.round(b, 6).alias("benefit"))


@query("SELECT * FROM (VALUES ('rs-001', false), ('rs-002', false), ('rs-003', true)) t(server_id, can_start)")
def can_start_migration(spark, d):
    names = spark.createDataFrame([("rs-001",), ("rs-002",), ("rs-003",)], "server_id string")
    return balance.can_start(names, spark.createDataFrame([("rs-001", "rs-002")], "source string, target string"))


@query(f"""WITH up AS (SELECT * FROM {_SERVERS} WHERE state = 'ONLINE'), a AS (SELECT avg(load) AS average FROM up),
    src AS (SELECT up.*, average FROM up, a WHERE load > average * 1.5 AND region_count >= 2), dst AS (SELECT up.* FROM up, a WHERE load < average),
    m AS (SELECT r.region_id, src.server_id AS source, dst.server_id AS target, src.load AS source_load, dst.load AS target_load, average, r.size_bytes / 1073741824.0::DOUBLE AS g,
        0.5::DOUBLE + 0.3::DOUBLE * (r.size_bytes / 1073741824.0::DOUBLE) AS w FROM {_ORDER_REGIONS} r JOIN src ON src.server_id = CAST(r.k % 10 + 90 AS VARCHAR), dst),
    b AS (SELECT *, (source_load - average) * (source_load - average) + (target_load - average) * (target_load - average)
        - ((source_load - w - average) * (source_load - w - average) + (target_load + w - average) * (target_load + w - average)) - 0.1::DOUBLE * g AS benefit FROM m),
    best AS (SELECT * FROM b WHERE benefit > 0 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY benefit DESC, region_id) = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY benefit DESC, region_id, target) AS n FROM best),
    p AS (SELECT *, row_number() OVER (ORDER BY source_load DESC, source, n) AS i FROM o), f AS (SELECT * FROM p WHERE i = 1),
    s AS (SELECT p.* FROM p, f WHERE p.source <> f.source AND p.target <> f.target ORDER BY p.i LIMIT 1)
    SELECT region_id, source, target, round(benefit, 6) AS benefit FROM (SELECT * FROM f UNION ALL SELECT * FROM s)""")
def migration_plans(spark, d):
    """Greedy plans: at most one per source and target, up to the limit of active moves."""
    placed = order_regions(spark, d).select("region_id", (F.col("k") % 10 + 90).cast("string").alias("server_id"), "size_bytes", F.lit("ONLINE").alias("state"))
    plans = balance.migration_plans(_loads(spark, d), placed, spark.createDataFrame([], "source string, target string"))
    return plans.withColumn("benefit", F.round("benefit", 6))


_STATE_OF = """CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'PREPARE' WHEN 'purchase' THEN 'SYNC' WHEN 'signup' THEN 'ROLLING_BACK' ELSE 'FAILED' END"""


@query(f"""WITH h AS (SELECT user_id AS migration_id, event_id AS seq, {_STATE_OF} AS after, lag({_STATE_OF}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT migration_id, seq, before, after, (before, after) IN (('PENDING', 'PREPARE'), ('PREPARE', 'SYNC'), ('PREPARE', 'ROLLING_BACK'), ('SYNC', 'ROLLING_BACK'), ('ROLLING_BACK', 'FAILED')) AS legal
    FROM h WHERE before IS NOT NULL""")
def migration_transitions(spark, d):
    history = read_table(spark, d, "events").select(F.col("user_id").alias("migration_id"), F.col("event_id").alias("seq"), F.expr(_STATE_OF).alias("state"))
    return migration.check_history(history)


def _tasks(spark, d):
    e = read_table(spark, d, "events")
    i = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "COMPLETED", "FAILED", "CANCELLED", "COMPLETED", "SYNC")]), (i % 6 + 1).cast("int"))
    return e.select(
        i.cast("string").alias("migration_id"), F.lit("r").alias("region_id"), F.lit("a").alias("source"), F.lit("b").alias("target"), state.alias("state"),
        i.alias("created_ms"), (i + 1000).alias("start_ms"), (i + 1000).alias("phase_ms"), F.when(state == "COMPLETED", i * 3 + 2000).alias("end_ms"),
        (i % 4).cast("int").alias("retry_count"), F.lit(None).cast("long").alias("retry_at_ms"), F.lit(False).alias("switched"), F.lit(None).cast("string").alias("error"),
    )


@query("""WITH t AS (SELECT event_id AS i, event_id % 6 AS m FROM events)
    SELECT count(*) AS total, count(*) FILTER (m IN (1, 4)) AS completed, count(*) FILTER (m = 2) AS failed, count(*) FILTER (m = 3) AS cancelled, count(*) FILTER (m IN (0, 5)) AS active,
    CAST(sum(CASE WHEN m IN (1, 4) THEN 2 * i + 1000 END) // count(*) FILTER (m IN (1, 4)) AS BIGINT) AS avg_duration_ms,
    round(count(*) FILTER (m IN (1, 4)) / count(*) FILTER (m IN (1, 2, 4))::DOUBLE, 9) AS success_rate FROM t""")
def migration_statistics(spark, d):
    return migration.statistics(_tasks(spark, d)).withColumn("success_rate", F.round("success_rate", 9))


@query("""WITH t AS (SELECT event_id AS i, event_id % 6 AS m, event_id % 12 = 5 AS ok, event_id % 12 = 11 AND 200000 - event_id - 1000 > 300000 AS late FROM events)
    SELECT CAST(i AS VARCHAR) AS migration_id, CASE m WHEN 0 THEN 'PREPARE' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'COMPLETED'
        ELSE CASE WHEN ok THEN 'SWITCH' WHEN late THEN 'ROLLING_BACK' ELSE 'SYNC' END END AS state,
    i AS created_ms, i + 1000 AS start_ms, CASE WHEN m = 0 OR (m = 5 AND (ok OR late)) THEN 200000 ELSE i + 1000 END AS phase_ms, CASE WHEN m IN (1, 4) THEN i * 3 + 2000 END AS end_ms,
    CAST(i % 4 AS INTEGER) AS retry_count, CAST(NULL AS BIGINT) AS retry_at_ms, false AS switched, CASE WHEN m = 5 AND late THEN 'sync timed out' END AS error FROM t""")
def migration_step(spark, d):
    tasks = _tasks(spark, d)
    done = tasks.where(F.col("created_ms") % 12 == 5).select("migration_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return migration.step(tasks, done, 200000).drop("region_id", "source", "target")


@query("""SELECT CAST(event_id AS VARCHAR) AS migration_id, CASE WHEN event_id % 3 = 0 THEN 'ROLLING_BACK' WHEN event_id % 3 = 1 THEN 'FAILED' ELSE 'PENDING' END AS state,
    CASE WHEN event_id % 3 = 2 THEN NULL ELSE 500000 END AS phase_ms, CASE WHEN event_id % 3 = 1 THEN 500000 END AS end_ms,
    CAST(event_id % 4 + CASE WHEN event_id % 3 = 1 AND event_id % 4 < 3 THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
    CASE WHEN event_id % 3 = 1 AND event_id % 4 < 3 THEN 500000 + 60000 * (2 ** (event_id % 4))::BIGINT END AS retry_at_ms,
    CASE WHEN event_id % 3 = 0 THEN 'disk' WHEN event_id % 3 = 1 THEN 'why' END AS error FROM events""")
def migration_retries(spark, d):
    """One step of tasks whose sync failed, whose rollback ended, and whose retry is due."""
    kind = F.col("created_ms") % 3
    state = F.when(kind == 0, "SYNC").when(kind == 1, "ROLLING_BACK").otherwise("FAILED")
    due = F.when(kind == 2, F.lit(400000).cast("long"))
    tasks = _tasks(spark, d).withColumns({"state": state, "retry_at_ms": due, "error": F.when(kind > 0, F.lit("why")), "end_ms": F.when(kind == 2, F.col("created_ms"))})
    done = tasks.where(kind < 2).select("migration_id", (kind == 1).alias("ok"), F.when(kind == 0, F.lit("disk")).alias("error"))
    return migration.step(tasks, done, 500000).select("migration_id", "state", "phase_ms", "end_ms", "retry_count", "retry_at_ms", "error")
