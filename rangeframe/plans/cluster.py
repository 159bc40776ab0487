"""Cluster membership as DataFrame programs: registration, heartbeats, time-outs, recovery, health.

Tables: servers(server_id, host, port, state, last_heartbeat, region_count, total_size_bytes, cpu_usage,
memory_usage) and server_regions(server_id, region_id, size_bytes). Time is always an argument.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeframe.functions.types import ServerState

SERVERS = (
    "server_id string, host string, port int, state string, last_heartbeat timestamp, region_count int, "
    "total_size_bytes long, cpu_usage double, memory_usage double"
)
SERVER_REGIONS = "server_id string, region_id string, size_bytes long"
#: Weights of the load score, and bytes of a GiB and a MiB.
WEIGHT_REGIONS, WEIGHT_GIB, WEIGHT_CPU, WEIGHT_MEMORY = 0.5, 0.3, 0.1, 0.1
GIB, MIB = 1 << 30, 1 << 20
HEARTBEAT_SECONDS, TIMEOUT_SECONDS, CHECK_SECONDS = 3, 30, 10

ONLINE, OFFLINE, DEAD = (s.value for s in (ServerState.ONLINE, ServerState.OFFLINE, ServerState.DEAD))


def load_score(regions: Column | str = "region_count", size: Column | str = "total_size_bytes", cpu: Column | str = "cpu_usage", memory: Column | str = "memory_usage") -> Column:
    """Load of a server; cpu and memory are percentages."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return WEIGHT_REGIONS * c(regions) + WEIGHT_GIB * (c(size) / F.lit(float(GIB))) + WEIGHT_CPU * c(cpu) + WEIGHT_MEMORY * c(memory)


def register(servers: DataFrame, server_id: str, host: str, port: int, now: datetime) -> tuple[DataFrame, str]:
    """(servers, id): a new id joins ONLINE; a DEAD one revives with its old address; any other id that is
    taken gets a suffix -1, -2, ..."""
    taken = {r.server_id: r.state for r in servers.where(F.col("server_id").startswith(server_id)).select("server_id", "state").collect()}
    if taken.get(server_id) == DEAD:
        hit = F.col("server_id") == server_id
        revived = servers.withColumn("state", F.when(hit, F.lit(ONLINE)).otherwise(F.col("state")))
        return revived.withColumn("last_heartbeat", F.when(hit, F.lit(now)).otherwise(F.col("last_heartbeat"))), server_id
    given, n = server_id, 0
    while given in taken:
        n += 1
        given = f"{server_id}-{n}"
    row = servers.sparkSession.createDataFrame([(given, host, port, ONLINE, now, 0, 0, 0.0, 0.0)], SERVERS)
    return servers.unionByName(row), given


def unregister(servers: DataFrame, server_regions: DataFrame, server_id: str) -> tuple[DataFrame, DataFrame]:
    """(servers, the server's regions): the server is OFFLINE, nothing is moved."""
    state = F.when(F.col("server_id") == server_id, F.lit(OFFLINE)).otherwise(F.col("state"))
    return servers.withColumn("state", state), server_regions.where(F.col("server_id") == server_id)


def latest_heartbeats(heartbeats: DataFrame, by: str = "server_id", at: str = "ts") -> DataFrame:
    """The last heartbeat of each server, with all its columns."""
    rest = [c for c in heartbeats.columns if c != by]
    return heartbeats.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(at)).alias("h")).select(by, *[F.col(f"h.{c}").alias(c) for c in rest])


def apply_heartbeats(servers: DataFrame, server_regions: DataFrame, heartbeats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(servers, server_regions, acknowledgements) after heartbeats (server_id, ts, region_count,
    total_size_bytes, cpu_usage, memory_usage, region_ids). DEAD servers revive, OFFLINE ones stay; regions that a
    server reports for the first time are added with size 0. Heartbeats of unknown servers are not acknowledged."""
    last = latest_heartbeats(heartbeats)
    metrics = ["region_count", "total_size_bytes", "cpu_usage", "memory_usage"]
    h = last.select("server_id", F.col("ts").alias("__ts"), *[F.col(m).alias(f"__{m}") for m in metrics])
    joined = servers.join(h, "server_id", "left")
    beat = F.col("__ts").isNotNull()
    updated = joined.select(
        "server_id", "host", "port",
        F.when(beat & (F.col("state") == DEAD), F.lit(ONLINE)).otherwise(F.col("state")).alias("state"),
        F.coalesce(F.greatest("__ts", "last_heartbeat"), F.col("last_heartbeat")).alias("last_heartbeat"),
        *[F.coalesce(f"__{m}", m).alias(m) for m in metrics],
    )
    reported = heartbeats.select("server_id", F.explode("region_ids").alias("region_id")).distinct()
    unseen = reported.join(server_regions, ["server_id", "region_id"], "left_anti").join(servers.select("server_id"), "server_id", "left_semi")
    regions = server_regions.unionByName(unseen.withColumn("size_bytes", F.lit(0).cast("long")))
    known = servers.select("server_id", F.lit(True).alias("known"))
    acks = last.select("server_id").join(known, "server_id", "left").select("server_id", F.coalesce("known", F.lit(False)).alias("acknowledged"))
    return updated, regions, acks


def report_region_online(server_regions: DataFrame, server_id: str, region_id: str, size_bytes: int) -> DataFrame:
    row = server_regions.sparkSession.createDataFrame([(server_id, region_id, size_bytes)], SERVER_REGIONS)
    return report_region_closed(server_regions, server_id, region_id).unionByName(row)


def report_region_closed(server_regions: DataFrame, server_id: str, region_id: str) -> DataFrame:
    return server_regions.where(~((F.col("server_id") == server_id) & (F.col("region_id") == region_id)))


def timed_out(servers: DataFrame, now: datetime, timeout_seconds: float = TIMEOUT_SECONDS) -> DataFrame:
    """ONLINE servers whose last heartbeat is longer ago than the timeout."""
    silent = F.lit(now).cast("timestamp").cast("double") - F.col("last_heartbeat").cast("timestamp").cast("double")
    return servers.where((F.col("state") == ONLINE) & (silent > timeout_seconds))


def mark_dead(servers: DataFrame, dead: DataFrame) -> DataFrame:
    marked = servers.join(dead.select("server_id", F.lit(True).alias("__dead")), "server_id", "left")
    return marked.withColumn("state", F.when(F.col("__dead"), F.lit(DEAD)).otherwise(F.col("state"))).select(*servers.columns)


def online(servers: DataFrame) -> DataFrame:
    return servers.where(F.col("state") == ONLINE)


def least_loaded(servers: DataFrame) -> DataFrame:
    """The ONLINE server of the least load; the smallest id of equals. No row if none is ONLINE."""
    return online(servers).withColumn("load", load_score()).orderBy("load", "server_id").limit(1)


def reassign(servers: DataFrame, server_regions: DataFrame, dead_id: str) -> DataFrame:
    """(region_id, target) for each region of a dead server: each goes to the server of the least load, and
    every assignment counts in the next one's choice. target is null where no server is ONLINE.

    The choice is sequential; it needs one row per ONLINE server on the driver, and the dead server's
    region ids.
    """
    spark = servers.sparkSession
    pool = {r.server_id: r.load for r in online(servers).where(F.col("server_id") != dead_id).select("server_id", load_score().alias("load")).collect()}
    regions = [(r.region_id, r.size_bytes) for r in server_regions.where(F.col("server_id") == dead_id).orderBy("region_id").collect()]
    plan = []
    for region_id, _ in regions:
        target = min(pool, key=lambda s: (pool[s], s)) if pool else None
        if target is not None:
            pool[target] += WEIGHT_REGIONS
        plan.append((region_id, target))
    return spark.createDataFrame(plan, "region_id string, target string")


def recover(servers: DataFrame, server_regions: DataFrame, now: datetime, timeout_seconds: float = TIMEOUT_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(servers, server_regions, assignments) after a check: silent servers are DEAD, their regions placed.

    The dead servers are taken in order of their ids, each with the loads that the ones before have left.
    One pass on the driver over a row per server and the dead servers' region ids; frames are joined once.
    """
    spark = servers.sparkSession
    dead = timed_out(servers, now, timeout_seconds).select("server_id")
    gone = sorted(r.server_id for r in dead.collect())
    pool = {r.server_id: r.load for r in online(servers).select("server_id", load_score().alias("load")).collect() if r.server_id not in set(gone)}
    lost = server_regions.where(F.col("server_id").isin(gone)).select("server_id", "region_id").collect() if gone else []
    plan = []
    for server_id, region_id in sorted(map(tuple, lost)):
        target = min(pool, key=lambda s: (pool[s], s)) if pool else None
        if target is not None:
            pool[target] += WEIGHT_REGIONS
        plan.append((server_id, region_id, target))
    done = spark.createDataFrame(plan, "server_id string, region_id string, target string")
    marked = mark_dead(servers, spark.createDataFrame([(d,) for d in gone], "server_id string"))
    more: dict[str, int] = {}
    for *_, target in plan:
        if target is not None:
            more[target] = more.get(target, 0) + 1
    counts = spark.createDataFrame(sorted(more.items()), "server_id string, more int")
    counted = marked.join(counts, "server_id", "left").withColumn("region_count", F.col("region_count") + F.coalesce("more", F.lit(0))).select(*servers.columns)
    moved = server_regions.join(done, ["server_id", "region_id"], "left").select(F.coalesce("target", "server_id").alias("server_id"), "region_id", "size_bytes")
    return counted, moved, done


#: What to do about a failed region, by the kind of failure: damaged or lagging data comes from another replica, a
#: broken disk gives its regions away, and what isn't understood is taken off line for a person to look at.
RECOVERY = {"CORRUPTION": "RESTORE_FROM_REPLICA", "REPLICA_SYNC_FAILED": "RESTORE_FROM_REPLICA", "DISK_ERROR": "REASSIGN", "UNKNOWN_ERROR": "MARK_OFFLINE"}


def recovery_action(kind: Column, replicas: Column | None = None) -> Column:
    """The action for a kind of failure; NONE for other kinds. A region without another replica (``replicas``: how many
    there are) can't be restored from one and is marked off line."""
    action = F.lit("NONE")
    for k, v in RECOVERY.items():
        action = F.when(kind == k, F.lit(v)).otherwise(action)
    if replicas is None:
        return action
    return F.when((action == "RESTORE_FROM_REPLICA") & (F.coalesce(replicas, F.lit(0)) < 2), "MARK_OFFLINE").otherwise(action)


def report_region_failure(failures: DataFrame, regions: DataFrame) -> DataFrame:
    """Answers to failure reports (server_id, region_id, failure_type): server_id, region_id, acknowledged, action."""
    known = regions.select("region_id", F.size("replicas").alias("n"))
    joined = failures.join(known, "region_id", "left")
    return joined.select("server_id", "region_id", F.lit(True).alias("acknowledged"), recovery_action(F.col("failure_type"), F.col("n")).alias("action"))


def cluster_stats(servers: DataFrame) -> DataFrame:
    """One row: total, online and dead servers, and regions on servers of any state."""
    return servers.agg(
        F.count(F.lit(1)).alias("total_servers"),
        F.count_if(F.col("state") == ONLINE).alias("online_servers"),
        F.count_if(F.col("state") == DEAD).alias("dead_servers"),
        F.coalesce(F.sum("region_count"), F.lit(0)).alias("total_regions"),
    )


def table_stats(regions: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """One row over regions(table_name, region_id, size_bytes, state, and rows if known): tables, regions, sizes, rows, regions
    that split or migrate, and the queries a second of ONLINE servers (column qps; 0 where nothing reports it)."""
    rows = F.sum("rows") if "rows" in regions.columns else F.lit(None).cast("long")
    one = regions.agg(
        F.countDistinct("table_name").alias("tables"),
        F.count(F.lit(1)).alias("regions"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.coalesce(rows, F.lit(0)).alias("total_row_count"),
        (F.avg("size_bytes") / F.lit(float(MIB))).alias("avg_region_mib"),
        F.count_if(F.col("state").isin("SPLITTING")).alias("splitting"),
        F.count_if(F.col("state").isin("MIGRATING")).alias("migrating"),
    )
    if servers is None or "qps" not in servers.columns:
        return one.withColumn("total_qps", F.lit(0).cast("long"))
    return one.crossJoin(online(servers).agg(F.coalesce(F.sum("qps"), F.lit(0)).alias("total_qps")))  # one row and one row


def cluster_health(servers: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: CRITICAL without an ONLINE server or with a region that has no ONLINE replica; DEGRADED with a
    DEAD server or a region that isn't ONLINE; else HEALTHY. regions: region_id, state, replicas."""
    s = servers.agg(F.count_if(F.col("state") == ONLINE).alias("online_servers"), F.count_if(F.col("state") == DEAD).alias("dead_servers"))
    up = online(servers).select(F.col("server_id").alias("replica"), F.lit(1).alias("up"))
    copies = regions.select("region_id", "state", F.explode_outer("replicas").alias("replica")).join(up, "replica", "left")
    per = copies.groupBy("region_id").agg(F.first("state").alias("state"), F.coalesce(F.sum("up"), F.lit(0)).alias("up"))
    r = per.agg(F.count_if(F.col("up") == 0).alias("lost_regions"), F.count_if(F.col("state") != "ONLINE").alias("unavailable_regions"))
    status = (
        F.when((F.col("online_servers") == 0) | (F.col("lost_regions") > 0), "CRITICAL")
        .when((F.col("dead_servers") > 0) | (F.col("unavailable_regions") > 0), "DEGRADED")
        .otherwise("HEALTHY")
    )
    # Both sides are one row.
    return s.crossJoin(r).select(status.alias("status"), "online_servers", "dead_servers", "lost_regions", "unavailable_regions")


def pending_commands(assignments: DataFrame) -> DataFrame:
    """(server_id, command, region_id): what servers are told after assignments (server_id, region_id, target)."""
    opened = assignments.where("target is not null").select(F.col("target").alias("server_id"), F.lit("OPEN").alias("command"), "region_id")
    return opened.unionByName(assignments.select("server_id", F.lit("CLOSE").alias("command"), "region_id"))
