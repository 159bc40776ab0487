"""Operations for administrators: what a command line would offer, as functions over engine and tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeframe.engine import Engine
from rangeframe.functions.types import InvalidRequest
from rangeframe.plans import balance, cluster, migration


def describe_table(engine: Engine, name: str) -> DataFrame:
    engine.catalog.table(name)
    return engine.catalog.columns_frame().where(F.col("table_name") == name).orderBy("pos")


def table_regions(engine: Engine, name: str) -> DataFrame:
    engine.catalog.table(name)
    return engine.catalog.regions_frame().where(F.col("table_name") == name).orderBy("start_key")


def cluster_status(engine: Engine, servers: DataFrame) -> DataFrame:
    return cluster.cluster_health(servers, engine.catalog.regions_frame())


def region_metrics(engine: Engine) -> DataFrame:
    return cluster.table_stats(engine.catalog.regions_frame())


def regions(engine: Engine) -> DataFrame:
    """All regions of all tables, in order."""
    return engine.catalog.regions_frame().orderBy("table_name", "start_key")


def move_region(engine: Engine, region_id: str, target: str, servers: DataFrame | None = None) -> dict[str, Any]:
    """Make ``target`` the primary of a region; with ``servers`` it must be an ONLINE one."""
    if servers is not None and cluster.online(servers).where(F.col("server_id") == target).isEmpty():
        raise InvalidRequest(f"{target} is not ONLINE")
    return {"success": True, "region_id": region_id, "primary": engine.move_region(region_id, target).primary}


def region_servers(servers: DataFrame) -> DataFrame:
    """Servers with their load, the least loaded first."""
    return servers.withColumn("load", cluster.load_score()).orderBy("load", "server_id")


def server_metrics(servers: DataFrame, server_id: str) -> DataFrame:
    found = region_servers(servers).where(F.col("server_id") == server_id)
    if found.isEmpty():
        raise InvalidRequest(f"unknown server {server_id}")
    return found


def cluster_metrics(engine: Engine, servers: DataFrame) -> DataFrame:
    """One row: tables, regions, bytes, rows, regions that split or migrate, queries a second."""
    return cluster.table_stats(engine.catalog.regions_frame(), servers)


def balance_status(servers: DataFrame, balancer: balance.Balancer) -> DataFrame:
    """One row: whether balance is needed, the average and largest load, and whether the balancer runs."""
    return balance.needs_balance(servers.withColumn("load", cluster.load_score()), balancer.config).withColumn("running", F.lit(balancer.running))


def balance_run(engine: Engine, servers: DataFrame, tasks: DataFrame, balancer: balance.Balancer, now_ms: int) -> DataFrame:
    """``tasks`` with a PENDING migration for each move that a check, asked for by hand, finds useful."""
    placed = engine.catalog.regions_frame().select("region_id", F.col("primary").alias("server_id"), "size_bytes", "state")
    active = tasks.where(migration.is_active()).select("source", "target")
    plans = balancer.check(servers.withColumn("load", cluster.load_score()), placed, active, now_ms / 1000, force=True)
    for p in plans.collect():  # at most the moves that may be under way at once
        tasks, _ = migration.submit(tasks, p.region_id, p.source, p.target, now_ms)
    return tasks


def admin_operation(engine: Engine, operation: str, target: str, path: str | None = None) -> dict[str, Any]:
    """FORCE_GC, COMPACT_REGION, FLUSH_REGION or DEBUG_DUMP; returns success and what was done."""
    if operation == "FORCE_GC":
        return {"success": True, "expired": engine.vacuum()}
    if operation == "FLUSH_REGION":
        return {"success": True, "regions": engine.flush(engine.catalog.region(target).table_name, [target])}
    if operation == "COMPACT_REGION":
        return {"success": True, "regions": engine.compact(engine.catalog.region(target).table_name, [target])}
    if operation == "DEBUG_DUMP":
        if not path:
            raise InvalidRequest("a dump needs a path")
        engine.table(target).write.mode("overwrite").parquet(path)
        return {"success": True, "path": path}
    raise InvalidRequest(f"unknown operation {operation!r}")
