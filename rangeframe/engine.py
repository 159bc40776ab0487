"""The engine: range-partitioned tables in Parquet with a catalog and a write log.

A region's rows are Parquet files of its own, sorted by key; the catalog names the folder of each. A read
opens the folders of the regions that its keys meet and nothing else; within them the typed key condition
prunes by min/max statistics. A write appends to the table's log (one Parquet folder per batch, which names
the regions that it touches). Reads merge the log into touched regions, with one join; other regions are
read as they are. ``flush`` rewrites touched regions only, by itself once the log is over ROLL_BYTES.

No row is dropped on the way: rows without a key or region and repeated keys are refused, and each rewrite
compares the rows that went in with the rows that are stored before it is published.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeframe.functions.keys import EVERYTHING, Ranges, decode, encode, points, range_condition, typed_bound
from rangeframe.functions.types import DuplicateKey, EngineError, InvalidRequest, RegionNotAvailable, RegionState, TableSchema, parse_create_table
from rangeframe.operators import access, mutate
from rangeframe.operators.replay import merge_on_read, tail
from rangeframe.operators.routing import prune, region_of, with_region
from rangeframe.plans.cluster import WEIGHT_REGIONS, load_score, online
from rangeframe.sources.catalog import Catalog, LogPart, Region

#: Bytes beyond which a region is split, and bytes of pending log beyond which it is flushed.
SPLIT_BYTES, ROLL_BYTES = 256 << 20, 64 << 20
#: Regions that an ordered scan reads one by one; more are sorted together.
ORDERED_REGIONS = 64
#: Key ranges up to which a log is filtered by a condition.
CONDITION_RANGES = 16


class Engine:
    def __init__(self, spark: SparkSession, root: str, roll_bytes: int = ROLL_BYTES):
        self.spark, self.root, self.roll_bytes = spark, root.rstrip("/"), roll_bytes
        self.catalog = Catalog(spark, self.root)
        self._cache: dict[tuple, DataFrame] = {}

    # Declaring

    def create_table(self, table: TableSchema | str, split_points: list[Any] | None = None, replicas: tuple[str, ...] = ()) -> list[Region]:
        """Declare a table from a schema or a CREATE TABLE statement, cut at typed split points."""
        schema = parse_create_table(table) if isinstance(table, str) else table
        return self.catalog.create_table(schema, [encode(x) for x in split_points or []], replicas)

    def drop_table(self, name: str, missing_ok: bool = False) -> int:
        n = self.catalog.drop_table(name, missing_ok)
        self.catalog.files.delete(f"{self.root}/data/{name}")
        self.forget()
        return n

    # Writing regions

    def _struct(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.catalog.schema(name).to_struct()])

    def _write_regions(self, name: str, rows: DataFrame, regions: list[Region], applied: int, given: bool = False) -> dict[str, Region]:
        """Write rows into new folders of these regions, one per region, sorted by key; returns the regions.

        Rows that come from outside (``given``) are checked against the schema and for repeated keys. Nothing is
        published here: on any problem the folders go and the table is as it was.
        """
        schema = self.catalog.schema(name)
        pk, struct = schema.primary_key, self._struct(name)
        base = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        error = mutate.problems(schema, rows) if given else F.lit(None).cast("string")
        typed = rows.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in struct], error.alias("__error"))
        placed = with_region(typed, pk, schema.key_type, [(r.start, r.end, r.region_id) for r in regions])
        # Ranges of the typed key keep regions apart and balance them, whatever their sizes. Equal keys meet in one
        # task, next to each other, so the window needs no other shuffle or sort than the layout has.
        dealt = placed.repartitionByRange(pk)
        repeated = F.row_number().over(Window.partitionBy("region_id", pk).orderBy(pk)) > 1 if given else F.lit(False)
        dealt = dealt.withColumn("__repeated", repeated)
        if not given:
            dealt = dealt.sortWithinPartitions("region_id", pk)
        seen = Observation()
        counts = F.count(F.lit(1)).alias("n"), F.max("__error").alias("error"), F.count_if("__repeated").alias("repeated"), F.count_if(F.col("region_id").isNull()).alias("homeless")
        dealt.observe(seen, *counts).drop("__error", "__repeated").write.partitionBy("region_id").parquet(base)
        found = seen.get
        written = self.spark.read.schema(T.StructType([*struct, T.StructField("region_id", T.StringType())])).parquet(base)
        stored = {r.region_id: r.n for r in written.groupBy("region_id").agg(F.count("*").alias("n")).collect()}  # a row per region
        try:
            if found["error"] is not None:
                raise InvalidRequest(found["error"])
            if found["homeless"]:
                raise InvalidRequest(f"no region of {name} holds the keys of {found['homeless']} rows")
            if found["repeated"]:
                raise DuplicateKey(f"{found['repeated']} rows of {name} repeat a key")
            if sum(stored.get(r.region_id, 0) for r in regions) != found["n"]:
                raise EngineError(f"{found['n']} rows went into regions of {name}, {sum(stored.values())} are stored")
        except EngineError:
            self.catalog.files.delete(base)
            raise
        out = {}
        for r in regions:
            folder = f"{base}/region_id={r.region_id}"
            n = stored.get(r.region_id, 0)
            out[r.region_id] = r.next(path=folder if n else None, rows=n, size_bytes=self.catalog.files.size(folder) if n else 0, applied=applied)
        return out

    def load(self, name: str, rows: DataFrame) -> None:
        """Replace a table's contents by ``rows``, all of them or, if one can't be stored, none."""
        t, schema = self.catalog.table(name), self.catalog.schema(name)
        if schema.primary_key not in rows.columns:
            raise InvalidRequest(f"column {schema.primary_key} is missing")
        if unknown := set(rows.columns) - set(schema.names):
            raise InvalidRequest(f"unknown columns {sorted(unknown)}")
        rows = rows.withColumns({n: mutate.default_of(schema, n) for n in schema.names if n not in rows.columns})
        new = self._write_regions(name, rows, self.catalog.table_regions(name), t.log_sequence, given=True)
        self.catalog.update_table(name, new, log=(), archive=(*t.archive, *t.log), applied_sequence=t.log_sequence)
        self.forget()

    # Reading

    def _stored(self, name: str, regions: list[Region]) -> DataFrame:
        paths = [r.path for r in regions if r.path]
        if not paths:
            return self.spark.createDataFrame([], self._struct(name))
        return self.spark.read.schema(self._struct(name)).parquet(*paths)

    def _log_struct(self, name: str) -> T.StructType:
        extra = {"pos": T.LongType(), "error": T.StringType(), "sequence_id": T.LongType(), "ts": T.LongType(), "op": T.StringType(), "present": T.ArrayType(T.StringType()), "region_id": T.StringType()}
        return T.StructType([*(T.StructField(n, t) for n, t in extra.items()), *self._struct(name)])

    def _parts(self, name: str, parts: list[LogPart]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self._log_struct(name)).drop("pos", "error")
        return self.spark.read.schema(self._log_struct(name)).parquet(*[p.path for p in parts]).where("error IS NULL").drop("pos", "error")

    def log(self, name: str) -> DataFrame:
        """The table's pending log, with typed columns."""
        return self._parts(name, list(self.catalog.table(name).log))

    def log_entries(self, name: str, start_sequence: int = 1, end_sequence: int = 0, region_id: str | None = None, batch_size: int = 0) -> DataFrame:
        """Entries of the log, pending or already in the regions, by sequence; folders outside the sequences aren't read."""
        t = self.catalog.table(name)
        parts = [p for p in (*t.archive, *t.log) if p.last >= start_sequence and (not end_sequence or p.first <= end_sequence)]
        return tail(self._parts(name, parts), start_sequence, end_sequence, region_id, batch_size)

    def prune_log(self, name: str, up_to: int) -> int:
        """Delete archived folders of the log whose entries are up to a sequence; returns how many went."""
        t = self.catalog.table(name)
        gone = [p for p in t.archive if p.last <= up_to]
        if gone:
            self.catalog.update_table(name, archive=tuple(p for p in t.archive if p.last > up_to))
            for p in gone:
                self.catalog.files.delete(p.path)
        return len(gone)

    def _hit(self, name: str, ranges: Ranges) -> list[Region]:
        """The regions that hold keys of the ranges; a closed one can't be read or written."""
        ids = prune(self.catalog.bounds(name), ranges)
        regions = [self.catalog.region(i) for i in ids]
        for r in regions:
            if r.state == RegionState.CLOSED.value:
                raise RegionNotAvailable(r.region_id)
        return regions

    def select(self, name: str, ranges: Ranges = EVERYTHING) -> DataFrame:
        """The table's rows in the regions that hold keys of these ranges (also other rows of these regions)."""
        regions, touched = self._hit(name, ranges), self.catalog.touched(name)
        stale = [r for r in regions if r.region_id in touched]
        if not stale:
            return self._stored(name, regions)
        ids = {r.region_id for r in stale}
        parts = [p for p in self.catalog.table(name).log if ids.intersection(p.regions)]
        log = self._parts(name, parts)
        if any(i not in ids for p in parts for i in p.regions):
            log = log.where(F.col("region_id").isin(sorted(ids)))
        schema = self.catalog.schema(name)
        if len(ranges) <= CONDITION_RANGES and ranges != EVERYTHING:
            pk = schema.primary_key
            wanted = [range_condition(pk, typed_bound(s, schema.key_type), typed_bound(e, schema.key_type)) for s, e in ranges]
            if all(w is not None for w in wanted):
                either = F.lit(False)
                for w in wanted:
                    either = either | w
                log = log.where(either)
        merged = merge_on_read(self._stored(name, stale), log, schema.primary_key)
        clean = [r for r in regions if r.region_id not in ids]
        return merged if not clean else self._stored(name, clean).unionByName(merged)

    def table(self, name: str, start: Any = None, end: Any = None) -> DataFrame:
        """The table's rows of [start, end), read from the regions that the range meets, with its log."""
        if start is not None and end is not None and start >= end:
            return self._stored(name, [])
        return access.within(self.select(name, [(encode(start), encode(end))]), self.catalog.schema(name).primary_key, start, end)

    def get(self, name: str, key: Any, columns: list[str] | None = None) -> Row | None:
        pk = self.catalog.schema(name).primary_key
        rows = self.select(name, points([key])).where(F.col(pk) == F.lit(key))
        return access.project(rows, columns).first()

    def exists(self, name: str, key: Any) -> bool:
        return self.get(name, key, [self.catalog.schema(name).primary_key]) is not None

    def batch_get(self, name: str, keys: list[Any], columns: list[str] | None = None) -> DataFrame:
        """One row per asked-for key, in order; only regions that hold one of the keys are opened."""
        pk = self.catalog.schema(name).primary_key
        return access.batch_get(self.select(name, points(keys)), pk, keys, columns)

    def batch_exists(self, name: str, keys: list[Any]) -> DataFrame:
        return access.exists(self.select(name, points(keys)), self.catalog.schema(name).primary_key, keys)

    def scan(self, name: str, start: Any = None, end: Any = None, columns: list[str] | None = None, filter: str | None = None, limit: int = 0, reverse: bool = False) -> DataFrame:
        """Rows of [start, end) in key order. Regions are in order already: where the log doesn't touch them each is
        sorted on its own, a partition per region, and nothing is shuffled."""
        pk = self.catalog.schema(name).primary_key
        ranges = [(encode(start), encode(end))] if start is None or end is None or start < end else []
        regions = self._hit(name, ranges)
        stored = [r for r in regions if r.path]
        if limit or not stored or len(stored) > ORDERED_REGIONS or self.catalog.touched(name).intersection(r.region_id for r in regions):
            return access.scan(self.table(name, start, end), pk, None, None, columns, filter, limit, reverse)
        order = F.col(pk).desc() if reverse else F.col(pk).asc()
        out = None
        for r in reversed(stored) if reverse else stored:
            part = access.within(self._stored(name, [r]), pk, start, end, filter).coalesce(1).sortWithinPartitions(order)
            out = part if out is None else out.union(part)
        return access.project(out, columns)

    def stream_scan(self, name: str, start: Any = None, end: Any = None, **options) -> Iterator[Row]:
        """Rows of a scan one by one, a partition at a time in the driver."""
        return self.scan(name, start, end, **options).toLocalIterator()

    def query(self, name: str, request: access.Query) -> DataFrame:
        if request.kind == "filter":
            return self.scan(name, request.start, request.end, list(request.columns), request.filter or "true", request.limit)
        return access.query(self.table(name, request.start, request.end), self.catalog.schema(name).primary_key, request)

    def partials(self, name: str, column: str, start: Any = None, end: Any = None) -> DataFrame:
        """Partial aggregates of each region that the range meets; ``access.combine_partials`` adds them up."""
        schema = self.catalog.schema(name)
        rows = with_region(self.table(name, start, end).select(*{schema.primary_key, column}), schema.primary_key, schema.key_type, self.catalog.bounds(name))
        return access.partial_aggregates(rows, "region_id", column)

    # Changing

    def _append(self, name: str, entries: DataFrame, base: int, whole: bool) -> DataFrame | None:
        """Write entries (pos, error, op, present and columns) to the log and publish those without an error.

        With ``whole`` one error refuses all of them. Returns the folder's report, or None if there are no entries.
        """
        schema, struct = self.catalog.schema(name), self._log_struct(name)
        path = f"{self.root}/data/{name}/log-{base:016d}-{uuid.uuid4().hex}"
        key = F.expr(f"try_cast(`{schema.primary_key}` AS {schema.key_type.simpleString()})")
        numbered = entries.withColumns({"sequence_id": F.lit(base) + F.col("pos") + 1, "ts": F.unix_micros(F.current_timestamp()), "region_id": region_of(key, schema.key_type, self.catalog.bounds(name))})
        numbered = numbered.withColumn("error", F.coalesce("error", F.when(F.col("region_id").isNull(), F.lit("no region holds the key"))))
        typed = [F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in struct]
        numbered.select(*typed).write.parquet(path)
        rows = self.spark.read.schema(struct).parquet(path)
        found = rows.groupBy("region_id", F.col("error").isNull().alias("ok")).agg(F.max("sequence_id").alias("last"), F.min("error").alias("error")).collect()  # two rows per region
        bad = sorted(r.error for r in found if not r.ok)
        touched = sorted(r.region_id for r in found if r.ok)
        closed = [i for i in touched if self.catalog.region(i).state == RegionState.CLOSED.value]
        if closed or (bad and whole):
            self.catalog.files.delete(path)
            raise RegionNotAvailable(closed[0]) if closed else InvalidRequest(bad[0])
        if not found:
            self.catalog.files.delete(path)
            return None
        t, last = self.catalog.table(name), max(r.last for r in found)
        part = LogPart(path, base + 1, last, tuple(touched), self.catalog.files.size(path))
        self.catalog.update_table(name, log_sequence=last, log=(*t.log, part) if touched else t.log)
        self.forget()
        return rows.select("pos", F.col("error").isNull().alias("ok"), "error", F.when(F.col("error").isNull(), F.col("sequence_id")).alias("sequence_id"))

    def _roll(self, name: str) -> None:
        """Flush a log that has grown over ``roll_bytes`` and split what has become too large."""
        if sum(p.size_bytes for p in self.catalog.table(name).log) > self.roll_bytes:
            self.flush(name)
            self.split_large(name)

    def put(self, name: str, row: dict[str, Any]) -> int:
        """Insert or update one row; columns that it doesn't name keep their values. Returns its sequence id."""
        report = self.batch_put(name, [row]).first()
        if not report.ok:
            raise InvalidRequest(report.error)
        return report.sequence_id

    def put_rows(self, name: str, rows: DataFrame, whole: bool = False) -> DataFrame:
        """Insert or update rows of a DataFrame in no particular order (distinct keys); returns a report.

        With ``whole`` one row that can't be stored refuses all of them.
        """
        # Numbers with gaps keep tasks apart: no ordering of all rows is needed for sequence ids.
        return self.batch_put(name, rows.withColumn("pos", F.monotonically_increasing_id()), whole)

    def delete_rows(self, name: str, keys: DataFrame) -> int:
        """Delete the rows of these keys (in the table's key column); returns how many there were."""
        pk = self.catalog.schema(name).primary_key
        there = self.select(name).select(pk).join(keys.select(pk), pk, "left_semi")
        entries = there.withColumns({"pos": F.monotonically_increasing_id(), "error": F.lit(None).cast("string")})
        report = self._append(name, self._deletes(name, entries), self.catalog.table(name).log_sequence, True)
        n = report.count() if report is not None else 0
        self._roll(name)
        return n

    def _deletes(self, name: str, rows: DataFrame) -> DataFrame:
        pk = self.catalog.schema(name).primary_key
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in self._struct(name) if f.name != pk}
        return rows.withColumns(nothing | {"op": F.lit("DELETE"), "present": F.lit(None).cast("array<string>")})

    def batch_put(self, name: str, rows: list[dict[str, Any]] | DataFrame, whole: bool = False) -> DataFrame:
        """Insert or update rows (given as DataFrame: with a pos column from 0); returns a report per row.

        Columns that the rows lack keep their values in rows that exist and take their DEFAULT in new ones.
        """
        schema = self.catalog.schema(name)
        pk, listed = schema.primary_key, not isinstance(rows, DataFrame)
        ranges = EVERYTHING
        if listed:
            struct = self._struct(name)
            names = [n for n in struct.names if any(n in r for r in rows)]
            unknown = {k for r in rows for k in r} - set(struct.names)
            if unknown:
                raise InvalidRequest(f"unknown columns {sorted(unknown)}")
            if len({frozenset(r) for r in rows}) > 1:
                raise InvalidRequest("rows of one batch name the same columns")
            ranges = points([r.get(pk) for r in rows])
            typed = T.StructType([T.StructField("pos", T.LongType())] + [struct[n] for n in names])
            rows = self.spark.createDataFrame([(k, *(r.get(n) for n in names)) for k, r in enumerate(rows)], typed)
        given = [n for n in schema.names if n in rows.columns]
        if unknown := set(rows.columns) - {"pos", *schema.names}:
            raise InvalidRequest(f"unknown columns {sorted(unknown)}")
        if pk not in given and (not listed or rows.columns != ["pos"]):
            raise InvalidRequest(f"column {pk} is missing")
        if pk not in given:
            return self.spark.createDataFrame([], "pos long, ok boolean, error string, sequence_id long")
        absent = [c for c in schema.columns if c.name not in given]
        if any(c.default is not None or not c.nullable for c in absent):  # whether a row is new matters
            checked = mutate.filled(schema, rows, self.select(name, ranges).select(pk))
        else:
            present = F.array(*[F.lit(n) for n in given]) if absent else F.lit(None).cast("array<string>")
            checked = rows.withColumns({c.name: F.lit(None).cast(c.to_field().dataType) for c in absent} | {"present": present})
        checked = checked.withColumns({"error": mutate.problems(schema, checked, given), "op": F.lit("PUT")})
        report = self._append(name, checked, self.catalog.table(name).log_sequence, whole)
        if report is None or listed:  # a request's rows: the report doesn't depend on the log's folder
            made = report.collect() if report is not None else []
            report = self.spark.createDataFrame(made, "pos long, ok boolean, error string, sequence_id long")
        self._roll(name)
        return report

    def delete(self, name: str, key: Any) -> bool:
        """Delete one row; whether it existed."""
        return bool(self.batch_delete(name, [key]).first().existed)

    def batch_delete(self, name: str, keys: list[Any]) -> DataFrame:
        """Delete rows; returns (pos, key, existed, sequence_id), as of before the call."""
        pk = self.catalog.schema(name).primary_key
        kind = self._struct(name)[pk].dataType
        table = self.select(name, points(keys))
        base = self.catalog.table(name).log_sequence
        rows = mutate.delete_report(table, pk, access.key_frame(table, pk, keys), base).collect()  # one row per key of the request
        report = self.spark.createDataFrame(rows, f"pos long, key {kind.simpleString()}, existed boolean, sequence_id long")
        entries = report.select("pos", F.col("key").alias(pk), F.lit(None).cast("string").alias("error"))
        if keys:
            self._append(name, self._deletes(name, entries), base, False)
            self._roll(name)
        return report.orderBy("pos")

    def flush(self, name: str, region_ids: list[str] | None = None) -> int:
        """Merge the log into the regions that it touches (of these, if given); returns how many were rewritten."""
        t, touched = self.catalog.table(name), self.catalog.touched(name)
        hit = [r for r in self.catalog.table_regions(name) if r.region_id in touched and (region_ids is None or r.region_id in region_ids)]
        if not hit:
            return 0
        ids = sorted(r.region_id for r in hit)
        log = self._parts(name, [p for p in t.log if set(ids).intersection(p.regions)]).where(F.col("region_id").isin(ids))
        merged = merge_on_read(self._stored(name, hit), log, t.schema.primary_key)
        new = {r.region_id: r for r in self.catalog.table_regions(name)} | self._write_regions(name, merged, hit, t.log_sequence)
        pending = [p for p in t.log if any(i in new and new[i].applied < p.last for i in p.regions)]
        done = [p for p in t.log if p not in pending]
        applied = min([p.first - 1 for p in pending], default=t.log_sequence)
        self.catalog.update_table(name, new, log=tuple(pending), archive=(*t.archive, *done), applied_sequence=applied)
        self.forget()
        return len(hit)

    def compact(self, name: str, region_ids: list[str] | None = None) -> int:
        """Flush the log, then rewrite all regions (of these, if given) without small files; returns regions written."""
        self.flush(name, region_ids)
        regions = self.catalog.table_regions(name)
        chosen = [r for r in regions if region_ids is None or r.region_id in region_ids]
        if not chosen:
            return 0
        new = self._write_regions(name, self._stored(name, chosen), chosen, self.catalog.table(name).log_sequence)
        self.catalog.update_table(name, {r.region_id: r for r in regions} | new)
        self.forget()
        return len(chosen)

    def vacuum(self) -> int:
        """Delete old snapshots and the data folders that the newest one doesn't name; returns how many folders went."""
        self.catalog.expire()
        used = {r.path.rsplit("/", 1)[0] for r in self.catalog.state.regions.values() if r.path}
        used |= {p.path for t in self.catalog.state.tables.values() for p in (*t.log, *t.archive)}
        gone = 0
        for table in self.catalog.files.names(f"{self.root}/data"):
            for folder in self.catalog.files.names(f"{self.root}/data/{table}"):
                if (path := f"{self.root}/data/{table}/{folder}") not in used:
                    self.catalog.files.delete(path)
                    gone += 1
        return gone

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes to any tables inside the block become one snapshot at its end; an exception undoes them. Reads inside
        the block see its writes. If another writer published meanwhile the block fails as a whole."""
        try:
            with self.catalog.transaction():
                yield
        finally:
            self.forget()

    # Regions

    def split_region(self, region_id: str, at: Any = None, right_server: str | None = None) -> tuple[Region, Region]:
        """Split a region at a key, or at its median key, which goes to the right half. ``right_server`` becomes
        the right half's primary (and a replica of it)."""
        r = self.catalog.region(region_id)
        name, schema = r.table_name, self.catalog.schema(r.table_name)
        self.flush(name, [region_id])
        r = self.catalog.region(region_id)
        rows = self._stored(name, [r])
        if at is None:
            at = median_key(rows, schema.primary_key)
        cut = encode(at)
        if at is None or not (r.start < cut and (not r.end or cut < r.end)):
            raise InvalidRequest(f"region {region_id} can't be split there")
        left = Region(f"{region_id}a", name, r.start, cut, r.replicas, r.primary, RegionState.ONLINE.value)
        right = replace(left, region_id=f"{region_id}b", start=cut, end=r.end)
        if right_server is not None:
            right = replace(right, primary=right_server, replicas=tuple(dict.fromkeys((*r.replicas, right_server))))
        made = self._write_regions(name, rows, [left, right], self.catalog.table(name).log_sequence)
        kept = {x.region_id: x for x in self.catalog.table_regions(name) if x.region_id != region_id}
        self.catalog.update_table(name, kept | made)
        self.forget()
        return made[left.region_id], made[right.region_id]

    def split_large(self, name: str, limit: int = SPLIT_BYTES, servers: DataFrame | None = None) -> list[str]:
        """Split every region over the limit once; returns their ids. With ``servers`` each right half goes to the
        ONLINE server of the least load, and counts in the choice for the next."""
        large = [r.region_id for r in self.catalog.table_regions(name) if r.size_bytes > limit and r.rows > 1]
        loads = {} if servers is None or not large else {r.server_id: r.load for r in online(servers).select("server_id", load_score().alias("load")).collect()}  # a row per server
        for region_id in large:
            target = min(loads, key=lambda s: (loads[s], s), default=None)
            self.split_region(region_id, right_server=target)
            if target is not None:
                loads[target] += WEIGHT_REGIONS
        return large

    def merge_regions(self, left_id: str, right_id: str) -> Region:
        """Merge two neighbours into the left one's id."""
        a, b = self.catalog.region(left_id), self.catalog.region(right_id)
        if a.table_name != b.table_name or not a.end or a.end != b.start:
            raise InvalidRequest(f"{left_id} and {right_id} aren't neighbours")
        name = a.table_name
        self.flush(name, [left_id, right_id])
        a, b = self.catalog.region(left_id), self.catalog.region(right_id)
        made = self._write_regions(name, self._stored(name, [a, b]), [replace(a, end=b.end)], self.catalog.table(name).log_sequence)
        kept = {x.region_id: x for x in self.catalog.table_regions(name) if x.region_id not in (left_id, right_id)}
        self.catalog.update_table(name, kept | made)
        self.forget()
        return made[left_id]

    def delete_region(self, region_id: str, drop_rows: bool = False) -> None:
        """Remove a region and its range; one that holds rows only with ``drop_rows``. Writes to the gap are refused."""
        self.flush(self.catalog.region(region_id).table_name, [region_id])
        self.catalog.delete_region(region_id, drop_rows)
        self.forget()

    def open_region(self, region_id: str) -> Region:
        return self.catalog.set_region_state(region_id, RegionState.ONLINE)

    def close_region(self, region_id: str) -> Region:
        return self.catalog.set_region_state(region_id, RegionState.CLOSED)

    def move_region(self, region_id: str, target: str) -> Region:
        """Make a server primary of a region; it becomes a replica first. No data moves on shared storage."""
        self.catalog.add_replica(region_id, target)
        return self.catalog.set_primary(region_id, target)

    def region_ranges(self, name: str) -> list[tuple[str, Any, Any]]:
        kind = self.catalog.schema(name).key_type
        return [(i, decode(s, kind), decode(e, kind)) for s, e, i in self.catalog.bounds(name)]

    # Result cache

    def cached(self, key: str, make) -> DataFrame:
        """A cached result; any change to the catalog drops it. The oldest go beyond 32 results."""
        at = (key, self.catalog.state.snapshot)
        if at not in self._cache:
            while len(self._cache) >= 32:
                self._cache.pop(next(iter(self._cache))).unpersist()
            self._cache[at] = make().cache()
        return self._cache[at]

    def forget(self) -> None:
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()


def median_key(rows: DataFrame, pk: str) -> Any:
    """The key at which half of the rows are below (the upper median); None for fewer than two rows."""
    # Range partitions narrow the place down: no task sorts more than its share. Their bounds come from a sample that
    # differs from one run of the plan to the next, so sizes and key are read from the same, stored partitions.
    # The id of a row is its partition, then its place in it.
    parts = rows.select(pk).repartitionByRange(pk).sortWithinPartitions(pk).withColumn("__at", F.monotonically_increasing_id()).persist()
    try:
        sizes = parts.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per partition
        left = sum(r.n for r in sizes) // 2
        for r in sorted(sizes) if left else []:
            if r.n > left:
                return parts.where(F.col("__at") == (r.part << 33) + left).first()[pk]
            left -= r.n
    finally:
        parts.unpersist()
    return None
