"""Mixing sources to target weights, without replacement within an epoch.

Targets share all words out by weight; none may exceed ``REPEATS`` times its
source's words, and what it would exceed goes to the others by weight. A source
gives as many whole epochs as fit its target. The rest is drawn by Efraimidis
and Spirakis: each document gets an exponential key divided by its quality, and
documents are taken by ascending key up to the remaining budget.

No source is sorted as a whole. Keys are counted in bins first; only the bin in
which a budget ends is sorted document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch, as_bytes, batch

REPEATS = 3
CYCLE = 3
BINS = 512  # for each factor of e that keys span
SEED = 20_240_101
_LETTERS = bytes(i for i in range(256) if chr(i).isascii() and chr(i).isalpha() or i >= 128)


def quality(text: bytes) -> float:
    """Between 0.05 and 1: the share of letters among the bytes that aren't blank."""
    solid = len(text) - sum(text.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    if not solid:
        return 0.05
    return max(0.05, 1 - len(text.translate(None, _LETTERS + b" \n\t\r\x0b\x0c")) / solid)


def _measured(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = as_bytes(b.column(at))
        more = [
            pa.array([len(t.split()) for t in texts], pa.int64()),
            pa.array([quality(t) for t in texts], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "size", "quality"])


def measured(docs: DataFrame, text: str) -> DataFrame:
    """Adds size, the number of words, and quality; null texts have no words."""
    from pyspark.sql.types import DoubleType, LongType, StructType

    schema = StructType([*docs.schema.fields]).add("size", LongType(), False).add("quality", DoubleType(), False)
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda x: _measured(x, at), schema)


def ranked(scratch: Scratch, names: DataFrame, column: str) -> DataFrame:
    """Adds place, from 0, by code point with null last; the values are distinct. Sorted in ranges, not in one task."""
    keys = [F.col(column).isNull(), F.col(column)]
    rows = names.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id is the partition's number, then the place within it.
    rows = scratch.save(rows.withColumn("id", F.monotonically_increasing_id()), "ranked")
    part, own = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:  # one for each partition
        starts.append((p, total))
        total += n
    before = scratch.spark.createDataFrame(starts, "part long, start long")
    return rows.withColumn("part", part).join(before, "part").withColumn("place", F.col("start") + own).drop("id", "part", "start")


def targets(scratch: Scratch, sources: DataFrame, cycle: int = CYCLE, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to sources (source, source_size); one row for each source.

    Weights are 1, 2, ... ``cycle`` by the sources' order, repeating. A round
    shares what is left among the sources that aren't at their bound; it ends
    when no share exceeds a bound, after as many rounds as sources at most.
    """
    rows = ranked(scratch, sources, "source").withColumn("weight", (F.col("place") % cycle + 1).cast("double"))
    bound = F.col("source_size") * float(repeats)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight
    while True:
        full = bound <= F.col("weight") * level
        r = rows.agg(
            F.sum(F.when(full, bound).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not r["open"]:
            break
        # Bounds only ever fill up as the level rises, so it never falls.
        now = (total - r["held"]) / r["open"]
        if now <= level:
            break
        level = now
    return scratch.save(rows.withColumn("target", F.least(bound, F.col("weight") * level)), "targets")


def drawn(scratch: Scratch, docs: DataFrame, cycle: int = CYCLE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and copies to docs (source, size, quality, tie).

    ``docs`` must be a written table. ``tie`` is a number that is the same for
    every run; rows that agree in all columns may stand for each other.
    """
    sizes = scratch.save(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = targets(scratch, sizes, cycle, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select("source", "source_size", "target", whole.alias("epochs"))
    goal = scratch.save(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "goal")

    u = (F.shiftrightunsigned(F.xxhash64("tie", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    key = -F.log(u) / F.col("quality")
    # Of documents of equal quality, whatever it is, no bin gets more than a thousandth.
    bin_ = F.floor(F.log(key) * BINS).cast("int")
    rows = docs.withColumn("key", key).withColumn("bin", bin_)
    full = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")  # 45 times BINS rows a source at most
    full = full.withColumn("before", before).withColumnRenamed("source", "s")
    ends = full.join(goal, F.col("s").eqNullSafe(F.col("source")))
    ends = ends.where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("n") > F.col("budget")))
    last = scratch.save(ends.groupBy("s").agg(F.min("bin").alias("last"), F.min_by("before", "bin").alias("start")), "last")
    goal = goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *(F.col(c).alias(f"g_{c}") for c in ("source", "source_size", "target", "epochs", "budget")), "last", "start"
    )
    goal = scratch.save(goal, "bounds")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    edge = F.col("bin") == F.col("last")
    # Without a last bin the budget covers the whole source, which rounding alone can leave.
    sure = F.coalesce(F.col("bin") < F.col("last"), F.lit(True))
    inner = rows.where(~F.coalesce(edge, F.lit(False))).withColumn("picked", sure)
    w = Window.partitionBy("source").orderBy("key", "tie", "size")
    run = F.col("start") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The document at the budget's end is taken if that comes nearer to it than leaving it.
    tight = rows.where(edge).withColumn("picked", run - F.col("size") / 2.0 <= F.col("g_budget"))
    out = inner.unionByName(tight)
    copies = F.when(F.col("size") > 0, F.col("g_epochs") + F.col("picked").cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", F.least(copies, F.lit(repeats).cast("long")))
    return out.select(*docs.columns, F.col("g_source_size").alias("source_size"), F.col("g_target").alias("target"), "copies")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix of documents (doc_id, text, source): doc_id, size, source_size, target, taken.

    A null source is a source, the last one. Null, empty and blank texts have
    size 0 and aren't taken. The draw depends on doc_id and text alone, so
    reruns agree and repeated rows have the same key; if the budget ends among
    rows that are alike, it doesn't matter which of them is taken.
    """
    scratch = Scratch(spark, "mix")
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("tie"), "text")
    rows = scratch.save(measured(rows, "text").drop("text"), "measured")
    out = drawn(scratch, rows)
    out = out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    return scratch.finish(out)


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as the mix takes them: each as many times as it has copies, none if it has none."""
    scratch = Scratch(spark, "mixed")
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key, text, source = (f"c{names.index(c)}" for c in ("doc_id", "text", "source"))
    rows = measured(inner, text).withColumn("tie", F.xxhash64(key, text)).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")
    thin = rows.select(F.col(source).alias("source"), "size", "quality", "tie", "row")
    copies = scratch.save(drawn(scratch, thin).where("copies > 0").select(F.col("row").alias("r"), "copies"), "copies")
    # Shuffled at every size: how much is taken grows with the documents, and isn't for broadcasting.
    out = rows.join(copies.hint("merge"), F.col("row") == F.col("r"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
