"""Queries of an engine's stored tables: reads with a pending log, writes, SQL statements, regions and the log itself."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rangeframe.engine import Engine
from rangeframe.functions.types import EngineError
from rangeframe.operators import access, joins
from rangeframe.plans import sql
from rangeframe.sources.workspace import new_root, read_table
from rangeframe.suite.registry import query
from rangeframe.suite.tables import money, orders, orders_engine, servers

_SHARED: dict[tuple[str, str], Engine] = {}


def change(engine: Engine, spark: SparkSession, d: str) -> Engine:
    """Orders with new prices for every hundredth key, without some others, and with two new keys, all in the log."""
    keys = orders(spark, d).select("o_orderkey")
    engine.put_rows("orders", keys.where("o_orderkey % 100 = 0").withColumn("o_totalprice", F.lit(1.25)))
    engine.delete_rows("orders", keys.where("o_orderkey % 1000 = 500"))
    engine.batch_put("orders", [{"o_orderkey": -3, "o_orderstatus": "N"}, {"o_orderkey": 10**9, "o_orderstatus": "N"}])
    return engine


def changed(spark: SparkSession, d: str) -> Engine:
    """One engine with a pending log for all queries that only read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SHARED:
        _SHARED[key] = change(orders_engine(spark, d), spark, d)
    return _SHARED[key]


#: Orders after ``change``.
_CHANGED = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 100 = 0 THEN 1.25 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 1000 <> 500 UNION ALL SELECT k, NULL, 'N', NULL, NULL, NULL FROM (VALUES (-3::BIGINT), (1000000000)) t(k))"""


@query(f"SELECT * FROM {_CHANGED} WHERE o_orderkey = 700")
def engine_get(spark, d):
    engine = changed(spark, d)
    return spark.createDataFrame([engine.get("orders", 700)], engine._struct("orders"))


@query(f"SELECT pos, key, o_orderkey IS NOT NULL AS found FROM (VALUES (0::BIGINT, 500::BIGINT), (1, -3), (2, 700), (3, 77777777), (4, -3)) k(pos, key) LEFT JOIN {_CHANGED} ON o_orderkey = key")
def engine_exists(spark, d):
    return changed(spark, d).batch_exists("orders", [500, -3, 700, 77777777, -3])


@query(f"""SELECT pos, key, o_orderkey IS NOT NULL AS found, o_totalprice, o_orderstatus FROM (VALUES (0::BIGINT, 1000000000::BIGINT), (1, 1400), (2, 500), (3, 11), (4, 1400)) k(pos, key)
    LEFT JOIN {_CHANGED} ON o_orderkey = key""")
def engine_batch_get(spark, d):
    return changed(spark, d).batch_get("orders", [10**9, 1400, 500, 11, 1400], ["o_totalprice", "o_orderstatus"])


@query(f"SELECT o_orderkey, o_totalprice FROM {_CHANGED} WHERE o_orderkey >= 450 AND o_orderkey < 7200 AND o_totalprice < 20000 ORDER BY o_orderkey")
def engine_scan(spark, d):
    return changed(spark, d).scan("orders", 450, 7200, ["o_orderkey", "o_totalprice"], "o_totalprice < 20000")


@query(f"SELECT o_orderkey, o_orderstatus FROM {_CHANGED} WHERE o_orderkey < 1510 ORDER BY o_orderkey DESC LIMIT 30")
def engine_scan_reverse(spark, d):
    return changed(spark, d).scan("orders", None, 1510, ["o_orderkey", "o_orderstatus"], limit=30, reverse=True)


@query(f"SELECT count(*) AS count FROM {_CHANGED} WHERE o_orderkey >= 100 AND o_orderkey < 9000 AND o_totalprice > 2")
def engine_count(spark, d):
    return changed(spark, d).query("orders", access.Query("count", 100, 9000, "o_totalprice > 2"))


@query(f"SELECT min(o_totalprice) AS value, count(o_totalprice) AS count FROM {_CHANGED} WHERE o_orderkey < 900")
def engine_aggregate(spark, d):
    return changed(spark, d).query("orders", access.Query("aggregate", None, 900, None, "MIN", "o_totalprice"))


@query(f"SELECT o_orderkey FROM {_CHANGED} WHERE o_totalprice = 1.25 AND o_orderkey >= 250 ORDER BY o_orderkey LIMIT 20")
def engine_filter(spark, d):
    return changed(spark, d).query("orders", access.Query("filter", 250, None, "o_totalprice = 1.25", columns=("o_orderkey",), limit=20))


@query(f"""SELECT 'orders-00000' || least(greatest(o_orderkey // 5000, 0), 7) AS region_id, count(o_orderkey) AS n, CAST(min(o_orderkey) AS BIGINT) AS least, CAST(max(o_orderkey) AS BIGINT) AS most
    FROM {_CHANGED} GROUP BY 1""")
def engine_partials(spark, d):
    return changed(spark, d).partials("orders", "o_orderkey").drop("total")


@query(f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN {_CHANGED} ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
def engine_semi_reduced_join(spark, d):
    small = read_table(spark, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
    return joins.reduced_join(small, changed(spark, d).table("orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


#: Conditions whose bounds aren't a literal beside the bare key, or look as if they were.
PREDICATES = [
    "2 * o_orderkey = 10", "o_orderkey = 6 - 1", "6 - o_orderkey = 5", "o_orderpriority = 'o_orderkey = 5'", "o_orderkey BETWEEN 1 AND 2 + 5", "o_orderkey IN (3, 700, 500, 1000000000)",
    "o_orderkey < 3 OR o_orderkey > 999999999", "NOT o_orderkey >= 12", "o_orderkey % 1000 = 499", "1200 > o_orderkey AND o_totalprice = 1.25", "-o_orderkey = 3",
    "o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 9)", "o_orderstatus = 'N' AND o_orderkey < 0",
]
@query(f"""SELECT unnest([{', '.join(str(k) for k in range(len(PREDICATES)))}]) AS i, unnest([{', '.join(f'c{k}' for k in range(len(PREDICATES)))}]) AS n
    FROM (SELECT {', '.join(f"(SELECT count(*) FROM {_CHANGED} WHERE {p.replace('FROM orders', f'FROM {_CHANGED}')}) AS c{k}" for k, p in enumerate(PREDICATES))})""")
def sql_predicates(spark, d):
    """How many rows each condition selects, from the regions that it is pruned to."""
    engine = changed(spark, d)
    counts = [sql.execute_query(engine, f"SELECT {k} AS i, count(*) AS n FROM orders WHERE {p}") for k, p in enumerate(PREDICATES)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM {_CHANGED} a JOIN {_CHANGED} b ON b.o_orderkey = a.o_orderkey + 100 WHERE a.o_totalprice = 1.25 AND a.o_orderkey < 2000""")
def sql_join(spark, d):
    return sql.execute_query(changed(spark, d), "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 100 WHERE a.o_totalprice = 1.25 AND a.o_orderkey < 2000")


# Writes

_DDL = "CREATE TABLE customer (c_custkey BIGINT NOT NULL, c_name VARCHAR(40) NOT NULL, c_acctbal DOUBLE, grade INT DEFAULT 7, PRIMARY KEY (c_custkey))"


def customers(spark: SparkSession, d: str) -> Engine:
    engine = Engine(spark, new_root(spark, "engine"))
    engine.create_table(_DDL, [100, 1000, 10_000])
    engine.load("customer", read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return engine


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'it''s WHERE c_custkey = 1, grade = 2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 9 = 0 THEN c_custkey * 0.5 ELSE c_acctbal END AS c_acctbal,
    CAST(CASE WHEN c_custkey % 9 = 0 THEN 8 ELSE 7 END AS INTEGER) AS grade FROM customer""")
def sql_update_not_null(spark, d):
    """UPDATE of a table with NOT NULL columns and defaults; the literal looks like clauses."""
    engine = customers(spark, d)
    sql.execute_update(engine, "UPDATE customer SET c_acctbal = c_custkey * 0.5D, grade = grade + 1 WHERE c_custkey % 9 = 0")
    sql.execute_update(engine, "UPDATE customer SET c_name = 'it\\'s WHERE c_custkey = 1, grade = 2' WHERE c_custkey % 9 = 0")
    return engine.table("customer")


@query("""SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS INTEGER) AS grade FROM customer WHERE c_custkey % 2 = 1
    UNION ALL SELECT -1 - c_custkey, 'new', CAST(NULL AS DOUBLE), 7 FROM customer""")
def put_default(spark, d):
    """New rows take the DEFAULT; a null that is given stays; columns that aren't given keep their values."""
    engine = customers(spark, d)
    keys = read_table(spark, d, "customer").select("c_custkey")
    engine.put_rows("customer", keys.where("c_custkey % 2 = 1").select("c_custkey", F.lit(None).cast("int").alias("grade"), F.lit(None).cast("double").alias("c_acctbal")))
    engine.put_rows("customer", keys.select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name")))
    return engine.table("customer").where("c_custkey < 0 OR c_custkey % 2 = 1")


@query("""SELECT c_custkey AS pos, c_custkey % 4 <> 0 AS ok, CASE WHEN c_custkey % 4 = 0 THEN 'column c_name is missing' END AS error FROM customer""")
def engine_put_report(spark, d):
    """A partial batch: keys that aren't there yet lack a NOT NULL column."""
    engine = customers(spark, d)
    k = F.col("c_custkey")
    rows = read_table(spark, d, "customer").select(k.alias("pos"), F.when(k % 4 == 0, -1 - k).otherwise(k).alias("c_custkey"), F.lit(1).alias("grade"))
    return engine.batch_put("customer", rows).select("pos", "ok", "error")


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey < 0) AS added, 'column c_name is null' AS error FROM customer")
def sql_insert_atomic(spark, d):
    """A statement with one bad row stores none."""
    engine, error = customers(spark, d), None
    try:
        sql.execute_update(engine, "INSERT INTO customer (c_custkey, c_name) SELECT -1 - c_custkey, CASE WHEN c_custkey = 77 THEN NULL ELSE 'x' END FROM customer")
    except EngineError as e:
        error = str(e)
    return engine.table("customer").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") < 0).alias("added")).withColumn("error", F.lit(error))


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS third FROM customer WHERE c_custkey % 3 <> 1")
def sql_transaction(spark, d):
    """One committed and one undone transaction of two statements each."""
    engine = customers(spark, d)
    with engine.transaction():
        sql.execute_update(engine, "DELETE FROM customer WHERE c_custkey % 3 = 1")
        sql.execute_update(engine, "UPDATE customer SET grade = 1 WHERE c_custkey % 3 = 0")
    try:
        with engine.transaction():
            sql.execute_update(engine, "DELETE FROM customer")
            sql.execute_update(engine, "INSERT INTO customer (c_custkey) VALUES (1)")
    except EngineError:
        pass
    return engine.table("customer").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == 1).alias("third"))


@query("""SELECT * FROM (VALUES ('good', ''), ('null key', 'column c_custkey is null'), ('repeated key', '1 rows of customer repeat a key'), ('too long', 'column c_name is longer than 40'),
    ('unknown column', 'unknown columns [''nope'']')) t(what, error), (SELECT count(*) AS n FROM customer)""")
def engine_load_checks(spark, d):
    """Loads that can't be stored as a whole are refused as a whole."""
    engine = customers(spark, d)
    base = read_table(spark, d, "customer").select("c_custkey", "c_name")
    first = base.where("c_custkey = 0")
    loads = {
        "good": base, "null key": base.unionByName(first.withColumn("c_custkey", F.lit(None).cast("long"))), "repeated key": base.unionByName(first),
        "too long": base.withColumn("c_name", F.when(F.col("c_custkey") == 9, F.repeat(F.lit("x"), 41)).otherwise(F.col("c_name"))), "unknown column": base.withColumn("nope", F.lit(1)),
    }
    out = []
    for what, rows in loads.items():
        error = ""
        try:
            engine.load("customer", rows)
        except EngineError as e:
            error = str(e)
        out.append((what, error, engine.table("customer").count()))
    return spark.createDataFrame(out, "what string, error string, n long")


@query("""SELECT c_custkey AS pos, c_custkey < 100 OR c_custkey >= 1000 AS ok, CASE WHEN c_custkey >= 100 AND c_custkey < 1000 THEN 'no region holds the key' END AS error,
    (SELECT count(*) FROM customer WHERE c_custkey < 100 OR c_custkey >= 1000) AS n FROM customer""")
def engine_gap_put(spark, d):
    """Keys of a region that was deleted are refused; all other writes are in the table after a flush."""
    engine = customers(spark, d)
    engine.delete_region("customer-000001", drop_rows=True)
    rows = read_table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), "c_custkey", F.lit("x").alias("c_name"))
    report = engine.batch_put("customer", rows)
    engine.flush("customer")
    return report.select("pos", "ok", "error").withColumn("n", F.lit(engine.table("customer").where("c_name = 'x'").count()).cast("long"))


@query("""SELECT * FROM (VALUES (0::BIGINT, 5::BIGINT, true, 1::BIGINT), (1, -1, false, 2), (2, 5, false, 3), (3, 0, true, 4)) t(pos, key, existed, sequence_id), (SELECT count(*) - 2 AS n FROM customer)""")
def engine_batch_delete(spark, d):
    engine = customers(spark, d)
    report = engine.batch_delete("customer", [5, -1, 5, 0])
    return report.withColumn("n", F.lit(engine.table("customer").count()).cast("long"))


# Regions and the log


@query("SELECT least(c_custkey // 500, 1) AS part, count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS first_key FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def engine_log_entries(spark, d):
    """Entries of a log of which one region is flushed and the other isn't, read back by sequence."""
    engine = customers(spark, d)
    keys = read_table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.lit(3).alias("grade"))
    engine.put_rows("customer", keys.where("c_custkey < 500"))
    engine.flush("customer")
    engine.put_rows("customer", keys.where("c_custkey >= 500"))
    part = F.least(F.floor(F.col("c_custkey") / 500), F.lit(1)).cast("long").alias("part")
    return engine.log_entries("customer").where("op = 'PUT' AND present = array('c_custkey', 'grade')").groupBy(part).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("""SELECT CASE WHEN c_custkey < 100 THEN 'customer-000000' WHEN c_custkey < 1000 THEN 'customer-000001' WHEN c_custkey < 10000 THEN 'customer-000002' ELSE 'customer-000003' END AS region_id,
    count(*) AS rows, bool_or(c_custkey >= 1000) AS pending FROM customer GROUP BY 1""")
def engine_flush_region(spark, d):
    """Regions after two of them are flushed: the log still holds the writes of the others."""
    engine = customers(spark, d)
    engine.put_rows("customer", read_table(spark, d, "customer").select("c_custkey", F.lit(1.5).alias("c_acctbal")))
    engine.flush("customer", ["customer-000000", "customer-000001"])
    pending = engine.catalog.touched("customer")
    assert engine.table("customer").where("c_acctbal <> 1.5").isEmpty()
    rows = [(r.region_id, r.rows, r.region_id in pending) for r in engine.catalog.table_regions("customer") if r.rows]
    return spark.createDataFrame(rows, "region_id string, rows long, pending boolean")


@query("""WITH h AS (SELECT CASE WHEN c_custkey < 100 THEN 0 WHEN c_custkey < 1000 THEN 1 WHEN c_custkey < 10000 THEN 2 ELSE 3 END AS r, c_custkey FROM customer),
    c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY r) AS n FROM h)
    SELECT 'customer-00000' || r || CASE WHEN n < 2 THEN '' WHEN i < n // 2 THEN 'a' ELSE 'b' END AS region_id, count(*) AS rows FROM c GROUP BY 1""")
def engine_split_large(spark, d):
    """Every region split at its median key."""
    engine = customers(spark, d)
    engine.split_large("customer", 1, servers(spark, d))
    rows = [(r.region_id, r.rows) for r in engine.catalog.table_regions("customer") if r.rows]
    return spark.createDataFrame(rows, "region_id string, rows long")


@query("""SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT CASE WHEN o_orderkey % 100 = 0 THEN 1.25 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey % 1000 <> 500 UNION ALL SELECT NULL UNION ALL SELECT NULL)""")
def engine_rolled_log(spark, d):
    """A log that is flushed by its size after each batch."""
    engine = orders_engine(spark, d)
    engine.roll_bytes = 1
    change(engine, spark, d)
    assert not engine.catalog.touched("orders")
    return engine.table("orders").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))
