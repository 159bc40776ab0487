"""Types, keys, catalog, routing, cluster, balancing and migrations on small literal cases."""

import random
import threading
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.dataframe import DataFrame

from rangeframe.engine import Engine
from rangeframe.functions.keys import encode, key_column
from rangeframe.functions.types import (
    Column,
    IllegalTransition,
    InvalidRequest,
    InvalidSchema,
    RegionNotFound,
    RegionState,
    TableExists,
    TableNotFound,
    TableSchema,
    parse_create_table,
    parse_type,
)
from rangeframe import suite
from rangeframe.operators import routing
from rangeframe.plans import admin, balance, cluster, migration
from rangeframe.sources.catalog import Catalog
from rangeframe.sources.jdbc import predicates, read_jdbc
from rangeframe.streaming.log_apply import Replica

T0 = datetime(2024, 1, 1)
USERS = TableSchema("users", (Column("user_id", "BIGINT", False), Column("username", "VARCHAR(50)", False), Column("email", "VARCHAR(100)")), "user_id")


def test_types():
    assert parse_type("varchar( 50 )") == T.StringType()
    assert parse_type("DECIMAL(10, 2)") == T.DecimalType(10, 2)
    for bad in ("JSON", "VARCHAR", "DECIMAL(50,2)"):
        with pytest.raises(InvalidSchema):
            parse_type(bad)
    s = parse_create_table("create table t (a bigint not null, b varchar(5) default 'x', c double comment 'it, (is)', primary key (a));")
    assert s.primary_key == "a" and s.column("b").default == "x" and s.column("c").comment == "it, (is)" and not s.column("a").nullable
    for bad in ("CREATE TABLE t (a BIGINT)", "CREATE TABLE t (a DOUBLE PRIMARY KEY)", "CREATE TABLE t (a BIGINT PRIMARY KEY, A INT)"):
        with pytest.raises(InvalidSchema):
            parse_create_table(bad)


def test_key_order(spark):
    keys = [-(1 << 63), -300, -1, 0, 5, 300, (1 << 63) - 1]
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("b", key_column("k", T.LongType()))
    assert [r.k for r in rows.orderBy("b").collect()] == sorted(keys)
    assert all(bytes(r.b) == encode(r.k) for r in rows.collect())
    text = spark.createDataFrame([("￿",), ("\U0001f600",), ("a",)], "k string").withColumn("b", key_column("k", T.StringType()))
    assert [r.k for r in text.orderBy("b").collect()] == ["a", "￿", "\U0001f600"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create_table(USERS, [b"m"], ("rs-1",))
    with pytest.raises(TableExists):
        c.create_table(USERS)
    assert c.stats() == {"table_count": 1, "region_count": 2}
    assert c.list_tables("us%") == ["users"] and c.list_tables("x%") == []
    v = c.state.snapshot
    c.add_replica("users-000000", "rs-9")
    assert c.state.snapshot == v + 1 and c.region("users-000000").version == 2
    c.add_replica("users-000000", "rs-9")
    assert c.region("users-000000").version == 2
    with pytest.raises(InvalidRequest):
        c.set_primary("users-000000", "rs-5")
    c.set_primary("users-000000", "rs-9")
    assert c.remove_replica("users-000000", "rs-9").primary is None
    assert c.set_region_state("users-000001", RegionState.SPLITTING).state == "SPLITTING"
    with pytest.raises(InvalidRequest):
        c.create_region("extra", "users", b"a", b"c")
    c.delete_region("users-000001")
    c.create_region("tail", "users", b"m", b"")
    again = Catalog(spark, f"file://{tmp_path}/c")
    assert again.state == c.state
    other = Catalog(spark, f"file://{tmp_path}/c")
    again.delete_region("tail")
    with pytest.raises(Exception, match="taken"):
        other.delete_region("tail")
    with pytest.raises(TableNotFound):
        c.schema("none")
    with pytest.raises(RegionNotFound):
        c.region("none")
    again.refresh()
    assert again.drop_table("users") == 1 and again.drop_table("users", missing_ok=True) == 0
    assert again.expire() > 0 and Catalog(spark, f"file://{tmp_path}/c").state == again.state


def test_membership(spark):
    servers = spark.createDataFrame([], cluster.SERVERS)
    servers, a = cluster.register(servers, "rs-001", "localhost", 8001, T0)
    servers, b = cluster.register(servers, "rs-001", "localhost", 8002, T0)
    assert (a, b) == ("rs-001", "rs-001-1")
    later = T0 + timedelta(seconds=31)
    dead = cluster.timed_out(servers, later)
    assert dead.count() == 2
    assert cluster.timed_out(servers, T0 + timedelta(seconds=30)).count() == 0
    servers = cluster.mark_dead(servers, dead.where("server_id = 'rs-001'"))
    servers, c = cluster.register(servers, "rs-001", "elsewhere", 1, later)
    assert c == "rs-001" and servers.where("server_id = 'rs-001'").first().host == "localhost"
    regions = spark.createDataFrame([("rs-001", "r1", 5), ("rs-001", "r2", 5)], cluster.SERVER_REGIONS)
    servers, left = cluster.unregister(servers, regions, "rs-001-1")
    assert left.count() == 0 and cluster.online(servers).count() == 1
    stats = cluster.cluster_stats(servers).first()
    assert (stats.total_servers, stats.online_servers, stats.dead_servers) == (2, 1, 0)


def test_recovery_spreads_regions(spark):
    beat = T0 + timedelta(seconds=100)
    rows = [("a", "h", 1, "ONLINE", T0, 3, 0, 0.0, 0.0), ("b", "h", 1, "ONLINE", beat, 0, 0, 0.0, 0.0), ("c", "h", 1, "ONLINE", beat, 1, 0, 0.0, 0.0)]
    placed = spark.createDataFrame([("a", f"r{k}", 1) for k in range(3)], cluster.SERVER_REGIONS)
    servers, after, plan = cluster.recover(spark.createDataFrame(rows, cluster.SERVERS), placed, beat)
    assert [(r.region_id, r.target) for r in plan.orderBy("region_id").collect()] == [("r0", "b"), ("r1", "b"), ("r2", "c")]
    assert servers.where("server_id = 'a'").first().state == "DEAD" and after.where("server_id = 'a'").count() == 0
    commands = {tuple(r) for r in cluster.pending_commands(plan).collect()}
    assert ("b", "OPEN", "r0") in commands and ("a", "CLOSE", "r2") in commands


@pytest.mark.parametrize(
    "loads, want",
    [
        ([], False),
        ([(1.0, 2), (1.1, 2)], False),
        ([(3.5, 3), (1.0, 2)], True),
        ([(3.0, 1), (1.0, 2)], False),
        ([(5.0, 5), (1.0, 2)], True),
        ([(2.0, 3), (2.1, 3)], False),
        ([(7.0, 1), (1.0, 2)], False),
    ],
)
def test_needs_balance(spark, loads, want):
    servers = spark.createDataFrame([(f"s{k}", "ONLINE", x, n) for k, (x, n) in enumerate(loads)], "server_id string, state string, load double, region_count int")
    assert balance.needs_balance(servers).first().needs_balance is want


def test_benefit_and_plans(spark):
    one = spark.range(1)
    assert one.select(balance.region_load(F.lit(2 << 30)).alias("x")).first().x == pytest.approx(1.1)
    assert one.select(balance.benefit(F.lit(3.0), F.lit(1.0), F.lit(1 << 30), F.lit(2.0)).alias("x")).first().x == pytest.approx(1.82)
    servers = spark.createDataFrame([("a", "ONLINE", 9.0, 5), ("b", "ONLINE", 1.0, 1), ("c", "ONLINE", 1.5, 1)], "server_id string, state string, load double, region_count int")
    regions = spark.createDataFrame([("r1", "a", 1 << 30, "ONLINE"), ("r2", "a", 2 << 30, "ONLINE"), ("r3", "a", 9 << 30, "OFFLINE")], "region_id string, server_id string, size_bytes long, state string")
    idle = spark.createDataFrame([], "source string, target string")
    assert [tuple(r)[:3] for r in balance.migration_plans(servers, regions, idle).collect()] == [("r2", "a", "b")]
    b = balance.Balancer()
    assert b.check(servers, regions, idle, 0).count() == 1 and b.check(servers, regions, idle, 599, force=True).count() == 0
    assert b.check(servers, regions, idle, 600).count() == 1
    busy = spark.createDataFrame([("a", "z")], "source string, target string")
    assert balance.migration_plans(servers, regions, busy).count() == 0


def test_best_moves_are_those_of_all_pairs(spark):
    """Sizes at, around and far from what a move is best at, some of them equal, against every region times every target."""
    pick = random.Random(5)
    servers = [(f"s{k}", "ONLINE", pick.choice([30.0, 31.5]) if k < 3 else pick.random() * 8, 3) for k in range(25)]
    regions = []
    for k in range(120):
        s, t = servers[k % 3][2], pick.choice(servers[3:])[2]
        top = int(((s - t) / 2 - 0.1 / 1.2 - 0.5) / 0.3 * 2**30)
        size = pick.choice([top + pick.randint(-3, 3), top + pick.choice([-1, 1]) * 2 ** pick.randint(8, 32), pick.randint(0, 3) << 30, None])
        regions.append((f"r{k * 7919 % 120}", f"s{k % 3}", size, "ONLINE" if k % 9 else "SPLITTING"))

    def benefit(s, t, size):
        g, square = size / float(2**30), lambda x: x * x
        r = 0.5 + 0.3 * g
        return square(s - a) + square(t - a) - (square(s - r - a) + square(t + r - a)) - 0.1 * g

    up = spark.createDataFrame(servers, "server_id string, state string, load double, region_count int").coalesce(1)
    a = up.agg(F.avg("load")).first()[0]
    want = {}
    for s in servers[:3]:
        for t in servers[3:]:
            if t[2] >= a:
                continue
            moves = [(-benefit(s[2], t[2], size), r) for r, at, size, state in regions if at == s[0] and state == "ONLINE" and size is not None]
            if (best := min(moves))[0] < 0:
                want[s[0], t[0]] = best[1], -best[0]
    held = spark.createDataFrame(regions, "region_id string, server_id string, size_bytes long, state string")
    got = balance.best_moves(up, held, spark.createDataFrame([], "source string, target string")).collect()
    assert len(got) == len(want) > 20 and {(r.source, r.target): (r.region_id, r.benefit) for r in got} == want


@pytest.fixture(scope="module")
def cluster_tables(spark, tmp_path_factory):
    """2,000 servers and 300 regions of few sizes."""
    d = str(tmp_path_factory.mktemp("cluster"))
    spark.range(2000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name")).write.parquet(f"{d}/supplier.parquet")
    spark.range(300_000).where("id % 7 > 0 OR id % 3000 < 900").select(F.col("id").alias("o_orderkey")).write.parquet(f"{d}/orders.parquet")
    db = duckdb.connect()
    for t in ("supplier", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return d, db


def most_rows(plan):
    """The most rows that a join of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return most_rows(plan.executedPlan())
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() or plan.nodeName() == "CartesianProduct" else 0
    return max([own, *map(most_rows, below)])


def test_best_regions_never_pairs_regions_with_targets(spark, cluster_tables):
    d, db = cluster_tables
    run, sql = suite.QUERIES["best_regions"]
    df = run(spark, d)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(db.execute(sql).fetchall()) and len(rows) > 1000
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= max(2000, len(rows))


def test_plans_take_few_moves_of_each_source(spark, cluster_tables, monkeypatch):
    """What is put in order and sent to the driver: no more moves of a source than may start."""
    d, db = cluster_tables
    run, sql = suite.QUERIES["migration_plans"]
    sent, iterate = [], DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *args: sent.append(self) or iterate(self, *args))
    assert sorted(tuple(r) for r in run(spark, d).collect()) == sorted(db.execute(sql).fetchall())
    assert len(sent) == 1 and max(r["count"] for r in sent[0].groupBy("source").count().collect()) == balance.BalanceConfig().max_active


def test_plans_pass_over_taken_targets(spark):
    servers = [(f"s{k}", "ONLINE", 60.0 + k, 3) for k in range(4)] + [(f"t{k}", "ONLINE", 1.0 + k // 2, 1) for k in range(9)]
    up = spark.createDataFrame(servers, "server_id string, state string, load double, region_count int")
    regions = spark.createDataFrame([(f"r{k}", f"s{k % 4}", k << 28, "ONLINE") for k in range(40)], "region_id string, server_id string, size_bytes long, state string")
    idle = spark.createDataFrame([], "source string, target string")
    plans = balance.migration_plans(up, regions, idle, balance.BalanceConfig(max_active=3, threshold=1.2)).collect()
    assert [(r.source, r.target) for r in plans] == [("s3", "t0"), ("s2", "t1"), ("s1", "t2")]


def test_migration_life(spark):
    config = migration.MigrationConfig(retries=1)
    tasks = spark.createDataFrame([], migration.TASKS)
    for bad in ((None, "a", "b"), ("r", "a", "a")):
        with pytest.raises(InvalidRequest):
            migration.submit(tasks, *bad, 1)
    tasks, m = migration.submit(tasks, "r", "a", "b", 1000)

    def step(now, ok=None, error=None):
        nonlocal tasks
        done = [] if ok is None else [(m, ok, error)]
        out = migration.step(tasks, spark.createDataFrame(done, "migration_id string, ok boolean, error string"), now, config)
        tasks = spark.createDataFrame(out.collect(), migration.TASKS)
        return tasks.first()

    assert step(2000).state == "PREPARE" and step(3000).state == "PREPARE"
    assert step(4000, True).state == "SYNC"
    assert step(4000 + 300_001).state == "ROLLING_BACK"
    r = step(310_000, True)
    assert (r.state, r.retry_count, r.retry_at_ms, r.end_ms) == ("FAILED", 1, 370_000, 310_000)
    assert tasks.where(migration.is_active(config)).count() == 0 and step(369_999).state == "FAILED"
    r = step(370_000)
    assert (r.state, r.phase_ms, r.end_ms, r.error) == ("PENDING", None, None, None)
    for now, state in ((370_001, "PREPARE"), (370_002, "SYNC"), (370_003, "SWITCH")):
        assert step(now, None if state == "PREPARE" else True).state == state
    with pytest.raises(IllegalTransition):
        migration.cancel(tasks, m, 5)
    assert step(370_009, True).end_ms == 370_009
    assert migration.cancel(tasks, m, 5)[1] is False and migration.retry(tasks, m, 5)[1] is False
    s = migration.statistics(tasks).first()
    assert (s.total, s.completed, s.avg_duration_ms, s.success_rate) == (1, 1, 368_009, 1.0)
    assert migration.by_server(tasks, "b").count() == 1 and migration.by_state(tasks, "FAILED").count() == 0


def test_statistics_and_progress(spark):
    rows = [("1", "COMPLETED", 1000, 3000), ("2", "COMPLETED", 2000, 6000), ("3", "FAILED", None, None), ("4", "CANCELLED", None, None), ("5", "PENDING", None, None)]
    full = [(i, "r", "a", "b", s, 1, x, None, y, 0, None, False, None) for i, s, x, y in rows]
    s = migration.statistics(spark.createDataFrame(full, migration.TASKS)).first()
    assert tuple(s)[:6] == (5, 2, 1, 1, 1, 3000)
    assert migration.statistics(spark.createDataFrame([], migration.TASKS)).first().success_rate == 0.0
    one = spark.createDataFrame([(500, 1000), (0, 0)], "a long, b long")
    assert [r[0] for r in one.select(migration.progress(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    with pytest.raises(Exception):
        spark.createDataFrame([(5, 1)], "a long, b long").select(migration.progress(F.col("a"), F.col("b"))).collect()
    for bad in ({"tick_ms": 0}, {"retries": -1}):
        with pytest.raises(ValueError):
            migration.MigrationConfig(**bad)
    assert migration.can_transition("SYNC", "SWITCH") and not migration.can_transition("FAILED", "PENDING")


def test_switch_adds_replica(spark):
    c = Catalog(spark)
    c.create_table(USERS, None, ("a",))
    old = migration.switch_route(c, "users-000000", "z")
    assert old == "a" and c.region("users-000000").primary == "z"
    migration.roll_back_route(c, "users-000000", old)
    assert c.region("users-000000").primary == "a"
    stale, _ = routing.report_stale_route(c.regions_frame(), "users", "users-000000", "z")
    assert stale


def test_progress_reports_are_appended(spark):
    row = lambda phase, n: ("a", "r", "m1", phase, n, None, n)
    history, acks = spark.createDataFrame([], migration.REPORTS), []
    for phase, n in (("STARTED", 0), ("DATA_COPIED", 5)):
        history, ack = migration.report_progress(history, spark.createDataFrame([row(phase, n)], migration.REPORTS))
        acks += [tuple(r) for r in ack.collect()]
    assert acks == [("m1", "STARTED", True, False), ("m1", "DATA_COPIED", True, False)]
    assert sorted((r.phase, r.bytes_transferred) for r in history.collect()) == [("DATA_COPIED", 5), ("STARTED", 0)]
    with pytest.raises(Exception):
        migration.report_progress(history, spark.createDataFrame([row("LOST", 1)], migration.REPORTS))[0].collect()


def test_health(spark):
    servers = spark.createDataFrame([("a", "h", 1, "ONLINE", T0, 0, 0, 0.0, 0.0), ("b", "h", 1, "DEAD", T0, 0, 0, 0.0, 0.0)], cluster.SERVERS)
    region = lambda state, who: spark.createDataFrame([("r", state, who)], "region_id string, state string, replicas array<string>")
    assert cluster.cluster_health(servers, region("ONLINE", ["a"])).first().status == "DEGRADED"
    assert cluster.cluster_health(servers, region("ONLINE", ["b"])).first().status == "CRITICAL"
    assert cluster.cluster_health(servers.where("server_id = 'a'"), region("ONLINE", ["a"])).first().status == "HEALTHY"
    assert cluster.cluster_health(servers.limit(0), region("ONLINE", []).limit(0)).first().status == "CRITICAL"


def test_balancer_loop(spark):
    s = spark.createDataFrame([("a", "ONLINE", 9.0, 5), ("b", "ONLINE", 1.0, 1)], "server_id string, state string, load double, region_count int")
    r = spark.createDataFrame([("r1", "a", 1 << 30, "ONLINE")], "region_id string, server_id string, size_bytes long, state string")
    idle, seen, calls = spark.createDataFrame([], "source string, target string"), threading.Event(), []
    b = balance.Balancer(balance.BalanceConfig(period_seconds=0.01, cooldown_seconds=0))

    def read():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("a check that fails")
        return s, r, idle

    for _ in range(2):  # a stopped one starts again
        seen.clear()
        b.start(read, lambda plans: (plans.count() == 1) and seen.set())
        with pytest.raises(InvalidRequest):
            b.start(read, print)
        assert seen.wait(60) and b.running
        b.stop()
        assert not b.running


def test_replica_takes_late_entries(spark, tmp_path):
    r = Replica(spark, f"file://{tmp_path}/r", ["k"], ["v"])
    entries = lambda *rows: spark.createDataFrame(list(rows), "sequence_id long, op string, k string, v int")
    assert r.state() is None and r.apply(entries()) == (0, -1)
    assert r.apply(entries((5, "PUT", "a", 5), (6, "DELETE", "b", None)), 0) == (2, 6)
    assert r.apply(entries((9, "PUT", "z", 9)), 0) == (0, 6)  # a batch that ran before
    assert r.apply(entries((1, "PUT", "c", 1), (2, "PUT", "a", 2), (3, "PUT", "b", 3)), 1) == (0, 6)
    r.COMPACT = 2
    assert r.apply(entries((7, "PUT", "d", 7)), 2) == (1, 7) and len(r._meta()["parts"]) == 1
    assert sorted(map(tuple, r.live().collect())) == [("a", 5), ("c", 1), ("d", 7)]


def test_jdbc_source(spark):
    schema = TableSchema("people", (Column("id", "BIGINT", False), Column("name", "VARCHAR(20)")), "id")
    edges = [None, 10, 20, None]
    bounds = [(encode(a), encode(b), str(k)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert predicates(schema, bounds) == ["id < 10", "id >= 10 AND id < 20", "id >= 20"]
    names = TableSchema("t", (Column("k", "VARCHAR(9)"),), "k")
    assert predicates(names, [(b"", b"", "0"), (b"o'c", b"", "1")]) == ["1 = 1", "k >= 'o''c'"]
    url = "jdbc:derby:memory:people;create=true"
    rows = spark.range(5, 25).select(F.col("id").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    rows.write.jdbc(url, "people", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = read_jdbc(spark, url, schema, bounds, properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert got.rdd.getNumPartitions() == 3 and sorted(map(tuple, got.collect())) == [(k, f"n{k}") for k in range(5, 25)]


def test_admin_of_regions_and_servers(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    e.create_table(USERS, [10, 20], ("a", "b"))
    e.load("users", spark.range(30).select(F.col("id").alias("user_id"), F.lit("x").alias("username")))
    rows = [("a", "h", 1, "ONLINE", T0, 9, 0, 0.0, 0.0), ("b", "h", 1, "ONLINE", T0, 0, 0, 0.0, 0.0), ("c", "h", 1, "DEAD", T0, 0, 0, 0.0, 0.0)]
    s = spark.createDataFrame(rows, cluster.SERVERS)
    assert [r.region_id for r in admin.regions(e).collect()] == [f"users-00000{k}" for k in range(3)]
    with pytest.raises(InvalidRequest):
        admin.move_region(e, "users-000001", "c", s)
    assert admin.move_region(e, "users-000001", "b", s)["primary"] == "b"
    assert [r.server_id for r in admin.region_servers(s).collect()] == ["b", "c", "a"]
    assert admin.server_metrics(s, "a").first().load == 4.5
    with pytest.raises(InvalidRequest):
        admin.server_metrics(s, "z")
    m = admin.cluster_metrics(e, s).first()
    assert (m.tables, m.regions, m.total_row_count, m.total_qps) == (1, 3, 30, 0)
    b = balance.Balancer()
    status = admin.balance_status(s, b).first()
    assert status.needs_balance and not status.running
    tasks = admin.balance_run(e, s, spark.createDataFrame([], migration.TASKS), b, 1000)
    assert [(t.source, t.target, t.state) for t in tasks.collect()] == [("a", "b", "PENDING")]


def test_executor_rolls_back(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    e.create_table(USERS, None, ("a",))
    tasks, m = migration.submit(spark.createDataFrame([], migration.TASKS), "users-000000", "a", "b", 0)

    class Broken(migration.RegionExecutor):
        def switch(self, task):
            super().switch(task)
            raise RuntimeError("lost")

    states = []
    for now in range(1, 8):
        tasks = migration.tick(tasks, Broken(e), now * 1000)
        states.append(tasks.first().state)
    r = e.catalog.region("users-000000")
    assert states[:5] == ["PREPARE", "SYNC", "SWITCH", "ROLLING_BACK", "FAILED"] and tasks.first().error == "lost"
    assert (r.primary, r.replicas, r.state) == ("a", ("a",), "ONLINE") and tasks.first().retry_count == 1


def test_metadata_of_many_regions_stays_small_to_write(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create_table(USERS, [encode(k) for k in range(20_000)])
    manifest = c.state.manifests["users"]
    c.update_table("users", log_sequence=5)
    assert c.state.manifests["users"] == manifest and c.files.size(f"{c.root}/catalog/{c.state.snapshot:012d}.json") < 2000
    assert Catalog(spark, c.root).state == c.state
