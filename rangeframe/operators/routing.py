"""Routing: which region holds a key, and which regions a range meets.

Regions are rows (region_id, table_name, start_key, end_key, ...) with binary bounds, sorted by start_key.
Keys are routed without a join: starts of the regions are sorted, so the region of a key is the number of
starts up to it. A few regions are a balanced tree of comparisons, which is compiled with the rest of the
stage; more are one literal array that an expression halves, log2(regions) comparisons a row inside the JVM.
Integer keys are compared as integers, other keys by their bytes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeframe.functions.keys import OPEN, Ranges, contains, decode, key_column, overlaps

#: Regions up to which a tree of comparisons is made.
TREE_REGIONS = 32
#: Regions up to which bounds stand in the plan of a lookup (about 20 MB); more are joined.
LITERAL_REGIONS = 1_000_000

REGION_SCHEMA = (
    "region_id string, table_name string, start_key binary, end_key binary, replicas array<string>, "
    "primary string, state string, version int, size_bytes long, rows long"
)

Bounds = list[tuple[bytes, bytes, str]]


def sorted_regions(regions: DataFrame, table: str | None = None) -> DataFrame:
    """Regions by start key; the open start comes first."""
    chosen = regions if table is None else regions.where(F.col("table_name") == table)
    return chosen.orderBy("start_key", "region_id")


def bounds_of(regions: DataFrame, table: str) -> Bounds:
    """(start, end, region_id) in order, for the driver: metadata of one table."""
    rows = sorted_regions(regions, table).select("start_key", "end_key", "region_id").collect()
    return [(bytes(r.start_key), bytes(r.end_key), r.region_id) for r in rows]


def cells(bounds: Bounds) -> Bounds:
    """The same regions without overlaps: where several hold a key, the first by (start, region_id) does."""
    ordered = sorted(bounds, key=lambda b: (b[0], b[2]))
    if all(a[1] != OPEN and a[1] <= b[0] for a, b in zip(ordered, ordered[1:])):
        return ordered
    edges = sorted({s for s, _, _ in ordered} | {e for _, e, _ in ordered if e != OPEN})
    out: Bounds = []
    held: list[tuple[bytes, str, bytes]] = []
    k = 0
    for at, until in zip(edges, [*edges[1:], OPEN]):
        while k < len(ordered) and ordered[k][0] <= at:
            heapq.heappush(held, (ordered[k][0], ordered[k][2], ordered[k][1]))
            k += 1
        while held and held[0][2] != OPEN and held[0][2] <= at:
            heapq.heappop(held)
        if held:
            out.append((at, until, held[0][1]))
    return out


def _halving(key: Column, starts: Column, n: int) -> Column:
    """How many of ``n`` sorted starts are up to the key."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    fits = lambda at, s: (at + s <= n) & (F.element_at(starts, F.least(at + s, F.lit(n))) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def _literals(values: list[str], kind: str = "string") -> Column:
    """A literal array, made from one string so that its size costs one call; the optimizer folds it."""
    made = F.split(F.lit("\n".join(values)), "\n")
    return made if kind == "string" else made.cast(f"array<{kind}>")


def region_of(key: Column, kind: T.DataType, bounds: Bounds) -> Column:
    """The region_id of a typed key among a table's regions; null in a gap and for a null key."""
    parts = cells(bounds)
    if not parts:
        return F.lit(None).cast("string")
    whole = isinstance(kind, T.IntegralType) and all(len(x) in (0, 8) for s, e, _ in parts for x in (s, e))
    if whole:
        value: Callable[[bytes], Column] = lambda b: F.lit(decode(b, kind)).cast("long")
        key = key.cast("long")
    else:
        value = F.lit
        key = key_column(key, kind)
    gap = [e != OPEN and (k + 1 == len(parts) or parts[k + 1][0] != e) for k, (_, e, _) in enumerate(parts)]
    if len(parts) <= TREE_REGIONS:

        def grow(low: int, high: int) -> Column:
            if high - low == 1:
                here = F.lit(parts[low][2])
                return F.when(key < value(parts[low][1]), here) if gap[low] else here
            middle = (low + high) // 2
            return F.when(key < value(parts[middle][0]), grow(low, middle)).otherwise(grow(middle, high))

        inside = key.isNotNull() if parts[0][0] == OPEN else key >= value(parts[0][0])
        return F.when(inside, grow(0, len(parts)))
    text = (lambda b: str(-(1 << 63) if b == OPEN else decode(b, kind))) if whole else (lambda b: b.hex().upper())
    array = "bigint" if whole else "string"
    key = key if whole else F.hex(key)  # hexadecimal digits sort like the bytes
    at = _halving(key, _literals([text(s) for s, _, _ in parts], array), len(parts))
    place = F.greatest(at, F.lit(1))
    found = F.element_at(_literals([i for _, _, i in parts]), place)
    inside = (at > 0) & key.isNotNull()
    if any(gap):
        ends = _literals([text(e) if g else text(s) for (s, e, _), g in zip(parts, gap)], array)
        holes = _literals(["1" if g else "0" for g in gap])
        inside &= (F.element_at(holes, place) == "0") | (key < F.element_at(ends, place))
    return F.when(inside, found)


def with_region(df: DataFrame, key: str, kind: T.DataType, bounds: Bounds, name: str = "region_id") -> DataFrame:
    """``df`` with the region of each row's key column."""
    return df.withColumn(name, region_of(F.col(f"`{key}`"), kind, bounds))


def route_for_key(regions: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, key, ...) with the region that holds the key: the first by start where regions overlap.

    One row for each row of ``keys``; keys of an unknown table, and keys in a gap, have a null region.
    """
    r = regions.select("table_name", "region_id", "start_key", "end_key", "primary")
    if regions.limit(LITERAL_REGIONS + 1).count() > LITERAL_REGIONS:
        return _route_by_join(r, keys)
    tables: dict[str, Bounds] = {}
    for t, i, s, e in r.select("table_name", "region_id", "start_key", "end_key").toLocalIterator():
        tables.setdefault(t, []).append((bytes(s), bytes(e), i))
    # One order over all tables: the table's name and the key in hexadecimal, "|" between them.
    named = lambda t: t.encode().hex().upper()
    rows = sorted((f"{named(t)}|{s.hex().upper()}", named(t), e.hex().upper(), i) for t, b in tables.items() for s, e, i in cells(b))
    if not rows:
        return keys.join(r.limit(0).drop("table_name"), F.lit(False), "left")
    name, high = F.hex(F.col("table_name").cast("binary")), F.hex("key")
    at = F.greatest(_halving(F.concat(name, F.lit("|"), high), _literals([x[0] for x in rows]), len(rows)), F.lit(1))
    pick = lambda k: F.element_at(_literals([x[k] for x in rows]), F.col("__at"))
    placed = keys.withColumn("__at", at)
    first = F.element_at(_literals([x[0] for x in rows]), F.col("__at"))
    inside = (pick(1) == name) & (F.concat(name, F.lit("|"), high) >= first) & ((pick(2) == "") | (high < pick(2)))
    placed = placed.withColumn("__region", F.when(inside, pick(3))).drop("__at")
    r = F.broadcast(r.drop("table_name"))  # at most LITERAL_REGIONS rows
    return placed.join(r, F.col("__region") == F.col("region_id"), "left").select(*keys.columns, "region_id", "start_key", "end_key", "primary")


def _route_by_join(regions: DataFrame, keys: DataFrame) -> DataFrame:
    r = regions.withColumnRenamed("table_name", "__t")
    numbered = keys.withColumn("__row", F.monotonically_increasing_id())
    held = (F.col("table_name") == F.col("__t")) & contains(F.col("key"), F.col("start_key"), F.col("end_key"))
    first = F.min(F.struct("start_key", "region_id", "end_key", "primary")).alias("r")
    found = numbered.join(r, held, "left").groupBy("__row", *keys.columns).agg(first)
    return found.select(*keys.columns, "r.region_id", "r.start_key", "r.end_key", "r.primary")


def routes_for_range(regions: DataFrame, table: str, low: bytes, high: bytes) -> DataFrame:
    """Regions of a table that meet [low, high), in order; none for an unknown table."""
    return sorted_regions(regions, table).where(overlaps(F.col("start_key"), F.col("end_key"), F.lit(low), F.lit(high)))


def prune(bounds: Bounds, ranges: Ranges) -> list[str]:
    """On the driver: ids of a table's sorted regions that hold keys of these ranges."""
    starts = [s for s, _, _ in bounds]
    hit: dict[int, None] = {}
    reach = bool(bounds) and any(a[1] == OPEN or a[1] > b[0] for a, b in zip(bounds, bounds[1:]))
    for low, high in ranges:
        # Regions that don't overlap are met from the one that begins up to the low end.
        first = 0 if reach else max(0, bisect_right(starts, low) - 1)
        last = len(bounds) if high == OPEN else bisect_left(starts, high)
        for k in range(first, last):
            if bounds[k][1] == OPEN or bounds[k][1] > low:
                hit[k] = None
    return [bounds[k][2] for k in sorted(hit)]


def layout_problems(regions: DataFrame) -> DataFrame:
    """Gaps, overlaps and inverted bounds of each table's regions: (table_name, region_id, problem)."""
    by_start = Window.partitionBy("table_name").orderBy("start_key", "region_id")
    empty = F.lit(b"")
    named = regions.select(
        "table_name", "region_id", "start_key", "end_key", F.lead("start_key").over(by_start).alias("next"), F.row_number().over(by_start).alias("n")
    )
    problem = (
        F.when((F.col("end_key") != empty) & (F.col("start_key") >= F.col("end_key")), "inverted")
        .when((F.col("n") == 1) & (F.col("start_key") != empty), "gap before")
        .when(F.col("next").isNull() & (F.col("end_key") != empty), "gap after")
        .when(F.col("next").isNotNull() & ((F.col("end_key") == empty) | (F.col("end_key") > F.col("next"))), "overlap")
        .when(F.col("next").isNotNull() & (F.col("end_key") < F.col("next")), "gap")
    )
    return named.select("table_name", "region_id", problem.alias("problem")).where("problem is not null")


def route_table(regions: DataFrame, tables: DataFrame, table: str, cached_version: int = 0) -> tuple[str, DataFrame | None]:
    """('not_found' | 'cached' | 'fresh', regions): no payload while the cached version is current."""
    row = tables.where(F.col("table_name") == table).select("version").first()
    if row is None:
        return "not_found", None
    if cached_version >= row.version:
        return "cached", None
    return "fresh", sorted_regions(regions, table)


def report_stale_route(regions: DataFrame, table: str, region_id: str, seen_primary: str | None) -> tuple[bool, DataFrame]:
    """(stale, current route): whether a caller's view of a region's primary is out of date."""
    current = regions.where((F.col("table_name") == table) & (F.col("region_id") == region_id))
    row = current.select("primary").first()
    return row is None or row.primary != seen_primary, current
