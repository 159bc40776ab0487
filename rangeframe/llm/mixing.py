"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is (its share of the target) x (rows of the target) / (its rows).
Each document draws its number of copies by inverting the Poisson distribution of its source's rate at a
uniform number made from a hash of its id and a seed: no state, no order, the same draw on any cluster.
Documents are exploded by their counts and dealt by a hash of (seed, id, copy), which no source, size or
group of copies can skew; within a task they are sorted by that hash, so the result is a random order.

Source statistics are counted over all rows with a map-side combine. Rates go back to documents in a
broadcast join only if they are within MAX_SOURCES and MAX_STEPS, which is checked; beyond it the documents are
salted, so that one source never meets in one task.

Cases: a null source is a source of its own; a null doc_id draws by the empty text, and rows with one
doc_id have one count; sources that the weights don't name get no copies, names without rows are
ignored; an empty table gives an empty result; further columns pass through, except that input columns
named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeframe.llm.common import apart, materialize, unit_hash

#: Sources whose rates are broadcast, and steps of their distribution functions (8 bytes each); the salt beyond that.
MAX_SOURCES, MAX_STEPS, SALTS = 10_000, 4_000_000, 64
#: Without weights, a source's target share follows its rows to this power.
POWER = 0.5
ADDED = ["rate", "n_copies", "copy", "mix_key"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", total: int | None = None) -> DataFrame:
    """source_key, n_rows, rate: the mean number of copies of a document by source. The documents are read once."""
    counts = materialize(docs.groupBy(F.col(source).alias("source_key")).agg(F.count(F.lit(1)).alias("n_rows")), "source-counts")
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(POWER)))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighted = counts.join(F.broadcast(given), F.col("source_key").cast("string").eqNullSafe(F.col("name"))).drop("name")
    sums = weighted.agg(F.sum("weight"), F.sum("n_rows")).first()  # one row
    if not sums[0]:
        return weighted.select("source_key", "n_rows", F.lit(0.0).alias("rate")).limit(0)
    rate = F.col("weight") / F.lit(float(sums[0])) * F.lit(float(sums[1] if total is None else total)) / F.col("n_rows")
    return weighted.select("source_key", "n_rows", rate.alias("rate"))


def poisson_steps(found: DataFrame) -> DataFrame:
    """``found`` (source_key, rate) with ``steps``: values of the Poisson distribution function at 0, 1, 2, ... up to where
    it is 1 in double precision. Running sums over a row for each step: linear in the rate."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    rows = found.select("source_key", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source_key").orderBy("k")
    logs = F.sum(F.when(F.col("k") > 0, F.log(F.col("rate")) - F.log(F.col("k").cast("double"))).otherwise(-F.col("rate"))).over(upto)
    summed = rows.withColumn("log", logs).withColumn("step", F.sum(F.exp("log")).over(upto))
    steps = summed.groupBy("source_key", "rate").agg(F.sort_array(F.collect_list(F.struct("k", "step"))).alias("s"))
    return steps.select("source_key", "rate", F.col("s.step").alias("steps"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    seed: int = 42,
    total: int | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """All columns of ``docs`` with rate, n_copies, copy (from 0) and mix_key, in a random global order."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    of, steps, drawn, salt, salted_as = apart([*docs.columns, *ADDED], "of_source", "steps", "u", "salt", "of_salt")
    found = materialize(poisson_steps(rates(docs, weights, source, total).where("rate > 0")), "source-rates")
    sizes = found.agg(F.count("*"), F.sum(F.size("steps"))).first()  # one row
    found = found.select(F.col("source_key").alias(of), "rate", F.col("steps").alias(steps))
    key = F.col(source).eqNullSafe(F.col(of))
    if sizes[0] <= MAX_SOURCES and (sizes[1] or 0) <= MAX_STEPS:
        rated = docs.join(F.broadcast(found), key)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt)
        salted = docs.withColumn(salted_as, F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(seed)), F.lit(SALTS)).cast("int"))
        rated = salted.join(found.select("*", salts), key & (F.col(salted_as) == F.col(salt))).drop(salted_as, salt)
    u = (unit_hash(F.lit(seed), F.lit("count"), F.col(doc_id)) + 0.5) / float(1 << 52)
    rated = rated.withColumn(drawn, u).withColumn("n_copies", F.expr(f"size(filter({steps}, s -> s < {drawn}))"))
    copies = rated.where("n_copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, n_copies - 1)")))
    mix_key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    dealt = copies.drop(of, steps, drawn).withColumn("mix_key", mix_key)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "mix_key").sortWithinPartitions("mix_key")
