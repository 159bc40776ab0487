"""Migrations of regions: a state machine over a table of tasks, advanced by pure DataFrame steps.

Task columns are TASKS; times are milliseconds and null where they haven't come. A step takes tasks and the
outcomes of the phases' work (migration_id, ok, error; a row only where the work has ended) and returns
tasks. End times are set on every end, a retry starts with clean phase times, and a switch that didn't
change the route is a failure.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rangeframe.functions.types import IllegalTransition, InvalidRequest, RegionState

TASKS = (
    "migration_id string, region_id string, source string, target string, state string, created_ms long, start_ms long, "
    "phase_ms long, end_ms long, retry_count int, retry_at_ms long, switched boolean, error string"
)
#: The legal transitions.
TRANSITIONS = {
    "PENDING": ("PREPARE", "CANCELLED"),
    "PREPARE": ("SYNC", "ROLLING_BACK", "CANCELLED"),
    "SYNC": ("SWITCH", "ROLLING_BACK", "CANCELLED"),
    "SWITCH": ("COMPLETED", "ROLLING_BACK"),
    "ROLLING_BACK": ("FAILED",),
    "COMPLETED": (),
    "FAILED": (),
    "CANCELLED": (),
}
REPORTS = (
    "server_id string, region_id string, migration_id string, phase string, bytes_transferred long, error_message string, "
    "reported_ms long"
)
#: The phases that a server reports.
PHASES = ("STARTED", "DATA_COPIED", "COMPLETED", "FAILED")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
NEXT = {"PREPARE": "SYNC", "SYNC": "SWITCH", "SWITCH": "COMPLETED"}


@dataclass(frozen=True)
class MigrationConfig:
    tick_ms: int = 5_000
    prepare_ms: int = 30_000
    sync_ms: int = 300_000
    switch_ms: int = 30_000
    rollback_ms: int = 60_000
    retries: int = 3
    retry_ms: int = 60_000

    def __post_init__(self) -> None:
        if min(self.tick_ms, self.prepare_ms, self.sync_ms, self.switch_ms, self.rollback_ms, self.retry_ms) <= 0:
            raise ValueError("periods must be positive")
        if self.retries < 0:
            raise ValueError("retries can't be negative")


def can_transition(before: str, after: str) -> bool:
    return after in TRANSITIONS.get(before, ())


def transition_frame(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "before string, after string")


def check_history(history: DataFrame, by: str = "migration_id", order: str = "seq", state: str = "state") -> DataFrame:
    """(by, order, before, after, legal) for each change in a history of states."""
    w = Window.partitionBy(by).orderBy(order)
    steps = history.select(by, order, F.lag(state).over(w).alias("before"), F.col(state).alias("after")).where("before is not null")
    legal = F.broadcast(transition_frame(history.sparkSession).withColumn("legal", F.lit(True)))  # a dozen rows
    return steps.join(legal, ["before", "after"], "left").select(by, order, "before", "after", F.coalesce("legal", F.lit(False)).alias("legal"))


def submit(tasks: DataFrame, region_id: str | None, source: str | None, target: str | None, now_ms: int) -> tuple[DataFrame, str]:
    """(tasks, id) with a new PENDING task."""
    if not region_id or not source or not target:
        raise InvalidRequest("a migration needs a region, a source and a target")
    if source == target:
        raise InvalidRequest("source and target are the same server")
    n = tasks.where(F.col("created_ms") == now_ms).count()
    given = f"migration-{now_ms}-{n + 1}"
    row = (given, region_id, source, target, "PENDING", now_ms, None, None, None, 0, None, False, None)
    return tasks.unionByName(tasks.sparkSession.createDataFrame([row], TASKS)), given


def retry_delay_ms(retry_count: Column, config: MigrationConfig = MigrationConfig()) -> Column:
    """1, 2, 4, ... minutes before retry 1, 2, 3, ..."""
    return (F.lit(config.retry_ms) * F.pow(F.lit(2.0), retry_count)).cast("long")


def step(tasks: DataFrame, outcomes: DataFrame, now_ms: int, config: MigrationConfig = MigrationConfig()) -> DataFrame:
    """Every task one step on: started, advanced, rolled back, failed, or retried."""
    o = outcomes.select("migration_id", F.col("ok").alias("__ok"), F.col("error").alias("__error"))
    t = tasks.join(o, "migration_id", "left")
    state, now = F.col("state"), F.lit(now_ms).cast("long")
    limit = F.when(state == "PREPARE", config.prepare_ms).when(state == "SYNC", config.sync_ms).when(state == "SWITCH", config.switch_ms).when(state == "ROLLING_BACK", config.rollback_ms)
    working = state.isin("PREPARE", "SYNC", "SWITCH")
    late = (now - F.col("phase_ms")) > limit
    failed = working & (F.coalesce(~F.col("__ok"), F.lit(False)) | (late & F.col("__ok").isNull()))
    done = working & F.coalesce(F.col("__ok"), F.lit(False))
    rolled = (state == "ROLLING_BACK") & (F.col("__ok").isNotNull() | late)
    retried = (state == "FAILED") & (F.col("retry_at_ms") <= now)
    following = F.when(state == "PREPARE", "SYNC").when(state == "SYNC", "SWITCH").when(state == "SWITCH", "COMPLETED")
    after = (
        F.when(state == "PENDING", "PREPARE").when(failed, "ROLLING_BACK").when(done, following).when(rolled, "FAILED").when(retried, "PENDING").otherwise(state)
    )
    again = rolled & (F.col("retry_count") < config.retries)
    moved = after != state
    reason = F.when(failed, F.coalesce(F.col("__error"), F.concat(F.lower(state), F.lit(" timed out"))))
    return t.select(
        "migration_id", "region_id", "source", "target",
        after.alias("state"),
        "created_ms",
        F.when(state == "PENDING", F.coalesce("start_ms", now)).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(retried, F.lit(None).cast("long")).when(moved, now).otherwise(F.col("phase_ms")).alias("phase_ms"),
        F.when((done & (state == "SWITCH")) | rolled, now).when(retried, F.lit(None).cast("long")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(again, now + retry_delay_ms(F.col("retry_count"), config)).when(retried | rolled, F.lit(None).cast("long")).otherwise(F.col("retry_at_ms")).alias("retry_at_ms"),
        F.when(rolled, F.lit(False)).when(done & (state == "SWITCH"), F.lit(True)).otherwise(F.col("switched")).alias("switched"),
        F.when(retried, F.lit(None).cast("string")).otherwise(F.coalesce(reason, F.col("error"))).alias("error"),
    )


def cancel(tasks: DataFrame, migration_id: str, now_ms: int) -> tuple[DataFrame, bool]:
    """(tasks, whether it was cancelled): false for unknown or ended tasks; a task that is switching or
    rolling back can't be cancelled."""
    row = tasks.where(F.col("migration_id") == migration_id).select("state").first()
    if row is None or row.state in TERMINAL:
        return tasks, False
    if not can_transition(row.state, "CANCELLED"):
        raise IllegalTransition(f"{row.state} -> CANCELLED")
    hit = F.col("migration_id") == migration_id
    return tasks.withColumn("state", F.when(hit, F.lit("CANCELLED")).otherwise(F.col("state"))).withColumn("end_ms", F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("end_ms"))), True


def retry(tasks: DataFrame, migration_id: str, now_ms: int) -> tuple[DataFrame, bool]:
    """(tasks, whether it will be retried): a FAILED task starts over at the next step."""
    hit = (F.col("migration_id") == migration_id) & (F.col("state") == "FAILED")
    found = not tasks.where(hit).isEmpty()
    return tasks.withColumn("retry_at_ms", F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("retry_at_ms"))), found


def by_state(tasks: DataFrame, state: str) -> DataFrame:
    return tasks.where(F.col("state") == state)


def by_server(tasks: DataFrame, server_id: str) -> DataFrame:
    return tasks.where((F.col("source") == server_id) | (F.col("target") == server_id))


def is_active(config: MigrationConfig = MigrationConfig()) -> Column:
    """Not ended, or failed with a retry to come."""
    return ~F.col("state").isin(*TERMINAL) | ((F.col("state") == "FAILED") & (F.col("retry_count") < config.retries))


def statistics(tasks: DataFrame) -> DataFrame:
    """One row: counts by outcome, the average duration of completed tasks in whole ms, the success rate."""
    state = F.col("state")
    timed = (state == "COMPLETED") & (F.col("start_ms") > 0) & (F.col("end_ms") > 0)
    sums = tasks.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(state == s).alias(s.lower()) for s in TERMINAL],
        F.count_if(~state.isin(*TERMINAL)).alias("active"),
        F.sum(F.when(timed, F.col("end_ms") - F.col("start_ms"))).alias("ms"),
        F.count_if(timed).alias("n"),
    )
    ended = F.col("completed") + F.col("failed")
    return sums.select(
        "total", "completed", "failed", "cancelled", "active",
        F.coalesce(F.floor(F.col("ms") / F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).cast("long").alias("avg_duration_ms"),
        F.when(ended > 0, F.col("completed") / ended).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def progress(synced: Column, total: Column) -> Column:
    """Share of rows that are synced; 0 without rows; an error for counts that can't be."""
    broken = (synced < 0) | (total < 0) | (synced > total)
    return F.when(broken, F.raise_error(F.lit("synced rows out of range")).cast("double")).when(total == 0, F.lit(0.0)).otherwise(synced / total)


def report_progress(history: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history with all reports appended, acknowledgements): both are frames of REPORTS; each report is
    acknowledged and none asks for an abort. A phase that isn't one of PHASES is an error."""
    phase = F.col("phase")
    known = F.when(phase.isin(*PHASES), phase).otherwise(F.raise_error(F.lit("unknown phase of a migration")).cast("string"))
    checked = reports.withColumn("phase", known)
    acks = checked.select("migration_id", "phase", F.lit(True).alias("acknowledged"), F.lit(False).alias("should_abort"))
    return history.unionByName(checked), acks


def switch_route(catalog, region_id: str, target: str) -> str | None:
    """Move a region's primary; returns the old one. The target becomes a replica first."""
    old = catalog.region(region_id).primary
    catalog.add_replica(region_id, target)
    catalog.set_primary(region_id, target)
    return old


def roll_back_route(catalog, region_id: str, old: str | None) -> None:
    """Give a region back to the primary that it had."""
    if old is not None:
        catalog.add_replica(region_id, old)
        catalog.set_primary(region_id, old)


class Executor(Protocol):
    """The work of the phases. Each returns True when it has ended, False when it goes on, and raises to fail."""

    def prepare(self, task: Row) -> bool: ...
    def sync(self, task: Row) -> bool: ...
    def switch(self, task: Row) -> bool: ...
    def roll_back(self, task: Row) -> bool: ...


class RegionExecutor:
    """Migrations of an engine's regions. Storage is shared, so what moves is who serves a region: the target becomes a
    replica, writes that are still in the log reach the region's files (both replicas read the same log meanwhile),
    and the route changes once the target lags by less than ``lag`` entries."""

    def __init__(self, engine, lag: int = 100):
        self.engine, self.catalog, self.lag = engine, engine.catalog, lag

    def prepare(self, task: Row) -> bool:
        r = self.catalog.region(task.region_id)
        if r.primary != task.source:
            raise InvalidRequest(f"{task.source} is not the primary of {task.region_id}")
        self.catalog.add_replica(task.region_id, task.target)
        self.catalog.set_region_state(task.region_id, RegionState.MIGRATING)
        return True

    def behind(self, region_id: str) -> int:
        """Entries of the log for a region that its files don't have: at most what its table's sequence is ahead."""
        r = self.catalog.region(region_id)
        t = self.catalog.table(r.table_name)
        return max((p.last - max(r.applied, p.first - 1) for p in t.log if region_id in p.regions), default=0)

    def sync(self, task: Row) -> bool:
        r = self.catalog.region(task.region_id)
        if self.behind(task.region_id):
            self.engine.flush(r.table_name, [task.region_id])
        return self.behind(task.region_id) < self.lag

    def switch(self, task: Row) -> bool:
        switch_route(self.catalog, task.region_id, task.target)
        self.catalog.set_region_state(task.region_id, RegionState.ONLINE)
        return True

    def roll_back(self, task: Row) -> bool:
        r = self.catalog.region(task.region_id)
        replicas = tuple(s for s in r.replicas if s != task.target)
        if task.source not in replicas:
            replicas = (*replicas, task.source)
        self.catalog.set_replicas(task.region_id, replicas, task.source)
        self.catalog.set_region_state(task.region_id, RegionState.ONLINE)
        return True


def run_phases(tasks: DataFrame, executor: Executor) -> DataFrame:
    """Outcomes (migration_id, ok, error) of the work of all tasks in a phase; no row where it goes on. One task's
    error is its own."""
    working = tasks.where(F.col("state").isin("PREPARE", "SYNC", "SWITCH", "ROLLING_BACK")).orderBy("created_ms", "migration_id")
    done = []
    for task in working.toLocalIterator():  # as many as may be under way at once
        phase = {"PREPARE": executor.prepare, "SYNC": executor.sync, "SWITCH": executor.switch, "ROLLING_BACK": executor.roll_back}[task.state]
        try:
            if phase(task):
                done.append((task.migration_id, True, None))
        except Exception as e:  # noqa: BLE001  # a task fails alone
            done.append((task.migration_id, False, str(e)))
    return tasks.sparkSession.createDataFrame(done, "migration_id string, ok boolean, error string")


def tick(tasks: DataFrame, executor: Executor, now_ms: int, config: MigrationConfig = MigrationConfig()) -> DataFrame:
    """Every task one step on, after the work of its phase; the result doesn't depend on ``tasks`` being read again."""
    stepped = step(tasks, run_phases(tasks, executor), now_ms, config)
    return tasks.sparkSession.createDataFrame(stepped.collect(), TASKS)  # a row per task
