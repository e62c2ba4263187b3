"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate r of copies, 0 <= r <= 2. Among all rates that meet the token
constraint of their source, sum(r * size) = target, those of greatest entropy (relative to
one copy of each, in the bounded form) tilt exponentially with a document's size,

    r = 2 * e / (1 + e),  e = exp(l * size / mean size of the source),

and the multipliers l solve the convex dual. Newton's method from l = 0 approaches each root
from one side, as the dual's gradient is concave above it and convex below. Each iteration
is one distributed aggregation over a histogram (source, size, documents), which is all that
the dual needs; multipliers are columns of a table, never collected.

Rates are then rounded into copies: the sizes of a source line up, each takes the whole
copies that fall into its stretch of the running sum of rates, and what the source then
misses is made up from the largest sizes that fit in it, CORRECTIONS times. All that runs
over the histogram. The documents of one source and size share their copies evenly by rank; ranks
come from groups of about GROUP documents, dealt by a hash of doc_id and text, so neither a
hot source nor a group of equal sizes, ids or texts meets in one task; rows of one hash are
equal, whichever of them is taken. A document takes at most 2 copies. Sums that decide are of
integers, so reruns agree.

Targets: sources by code point of their name, null last, weigh WEIGHTS, repeating; they share
SHARE times all words, a source stopping at LIMIT times its own, the excess reshared by
weight until none is above. That is the level of one water-filling over the sources ordered
by capacity per weight.

Defined cases: null or empty text has size 0 and takes 0 words (its copies follow its rate,
1); a null source is a source; repeated rows, also of null doc_id, are documents of their
own; a source without words has target 0; an empty table gives no rows; extra columns are
kept only on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize

WEIGHTS, SHARE, LIMIT, ROUNDS, TOLERANCE, CORRECTIONS, GROUP, UNIT = (5, 2, 1), 1.5, 2.0, 40, 1e-6, 3, 500, 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) -> with target. Windows run over the sources alone."""
    everything = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rows = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * LIMIT)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(all_) * SHARE).withColumn("weights", F.sum("w").over(all_))
    left, free = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.col("weights") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("full", F.col("cap") * free <= F.col("w") * left)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_)
    held = F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(all_)
    level = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("w") * (F.col("budget") - spent) / (F.col("weights") - held)))
    return rows.withColumn("target", level).select("source", "source_size", "target")


def _rate(multiplier: Column, x: Column) -> Column:
    return F.lit(LIMIT) / (1 + F.exp(-F.greatest(F.least(multiplier * x, F.lit(700.0)), F.lit(-700.0))))


def multipliers(histogram: DataFrame, sources: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, l): roots of sum(n * size * rate) = target, by Newton iterations on the dual.

    histogram: (source, size, n). A source whose target is its limit has l = null (rate LIMIT).
    """
    open_ = sources.where(F.col("target") < F.col("source_size") * LIMIT * (1 - 1e-12)).select("source", "source_size", "target")
    means = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    points = materialize(open_.join(means, open_["source"].eqNullSafe(means["source"])).select(open_["source"], "source_size", "target", "mean", F.lit(0.0).alias("l")).where("mean > 0"), "mix-sources")
    for _ in range(rounds):
        at = points.select(F.col("source").alias("s"), "mean", "l")
        joined = histogram.where("size > 0").join(at, histogram["source"].eqNullSafe(at["s"])).withColumn("x", F.col("size") / F.col("mean"))
        r = _rate(F.col("l"), F.col("x"))
        unit = F.lit(float(1 << 40))
        sums = joined.groupBy("s").agg(F.sum(F.round(F.col("n") * F.col("x") * r * unit).cast("decimal(38,0)")).cast("double").alias("g"), F.sum(F.round(F.col("n") * F.col("x") * F.col("x") * r * (1 - r / LIMIT) * unit).cast("decimal(38,0)")).cast("double").alias("h"))
        want = F.col("target") / F.col("mean")
        step = (want - F.col("g") / float(1 << 40)) / F.greatest(F.col("h") / float(1 << 40), F.lit(1e-12))
        miss = F.abs(want - F.col("g") / float(1 << 40)) / F.greatest(want, F.lit(1e-9))
        moved = points.join(sums, points["source"].eqNullSafe(sums["s"])).select("source", "source_size", "target", "mean", F.when(miss > tolerance, F.col("l") + F.greatest(F.least(step, F.lit(20.0)), F.lit(-20.0))).otherwise(F.col("l")).alias("l"), miss.alias("miss"))
        moved = materialize(moved, "mix-multipliers")
        worst = moved.agg(F.max("miss")).first()[0]
        points = moved.drop("miss")
        if worst is None or worst <= tolerance:
            break
    return points.select("source", "mean", "l")


def group_copies(per: DataFrame, rounds: int = CORRECTIONS) -> DataFrame:
    """per (source, size, n, source_size, target, rate) -> with copies, of all documents of one source and size together.

    Copies are whole steps of the running sum of rates by size; then, a few times, the size
    nearest to what its source still misses gives or takes one copy.
    """
    line = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(line) + F.lit(UNIT // 2)
    step = F.shiftright(upto, 20) - F.shiftright(upto - F.col("n") * F.col("rate"), 20)
    out = per.withColumn("copies", step.cast("long"))
    whole, falling = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(rounds):
        out = out.withColumn("miss", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
        can = F.when(F.col("miss") > 0, F.col("n") * int(LIMIT) - F.col("copies")).otherwise(F.col("copies"))
        can = F.when((F.col("size") > 0) & (F.col("size") <= F.abs("miss")), can).otherwise(F.lit(0))
        out = out.withColumn("can", can).withColumn("used", F.coalesce(F.sum(F.col("can") * F.col("size")).over(falling), F.lit(0)))
        take = F.least(F.col("can"), F.floor(F.greatest(F.abs("miss") - F.col("used"), F.lit(0.0)) / F.greatest("size", F.lit(1))))
        out = out.withColumn("copies", (F.col("copies") + F.signum("miss").cast("long") * take).cast("long")).drop("miss", "can", "used")
    return materialize(out, "mix-copies")


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id if none are named), size, source_size, target, copies and taken of every row."""
    keep = keep or ["doc_id"]
    salt = F.xxhash64(F.lit(10), "doc_id", "text")
    inner = {c: f"_k{i}" for i, c in enumerate(keep)}
    key = [F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), salt.alias("hash")]
    if keep == ["doc_id"]:
        rows = heads = materialize(docs.select(F.col("doc_id").alias("_k0"), *key), "mix-sizes")
    else:
        rows, heads = docs.select(*[F.col(c).alias(inner[c]) for c in keep], *key), materialize(docs.select(*key), "mix-sizes")
    histogram = materialize(heads.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = materialize(targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "mix-targets")
    l = multipliers(histogram, sources)
    of = sources.join(l.withColumnRenamed("source", "s"), sources["source"].eqNullSafe(F.col("s")), "left").drop("s")
    per = histogram.join(of.withColumnRenamed("source", "s"), histogram["source"].eqNullSafe(F.col("s"))).drop("s")
    full = F.col("target") >= F.col("source_size") * LIMIT * (1 - 1e-12)
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).when(full, F.lit(LIMIT)).otherwise(_rate(F.col("l"), F.col("size") / F.col("mean")))
    per = group_copies(per.select("source", "size", "n", "source_size", "target", F.round(rate * UNIT).cast("long").alias("rate")))
    per = per.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", F.col("copies").alias("total"), F.ceil(F.col("n") / GROUP).alias("salts"))
    # where each salted part of a group of equal sizes begins; groups of one part begin at 0
    many = per.where("salts > 1").select("s", "z", "salts")
    parts = heads.join(many, heads["source"].eqNullSafe(many["s"]) & (heads["size"] == many["z"])).groupBy("s", "z", F.pmod("hash", "salts").alias("part")).agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("s", "z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "z", "part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"))
    found = rows.join(per, rows["source"].eqNullSafe(F.col("s")) & (rows["size"] == F.col("z"))).drop("s", "z").withColumn("salt", F.pmod("hash", "salts"))
    found = found.join(parts, found["source"].eqNullSafe(parts["s"]) & (found["size"] == parts["z"]) & (found["salt"] == parts["part"]), "left").drop("s", "z", "part")
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("hash"))
    found = found.withColumn("rank", rank)
    # the group's copies spread evenly over its documents: each gets the floor or the ceiling of their mean
    copies = F.expr("cast(rank * total div n - (rank - 1) * total div n as bigint)")
    found = found.withColumn("copies", copies)
    return found.select(*[F.col(inner[c]).alias(c) for c in keep], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def resample(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; the same columns."""
    names = docs.columns
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", "text")
    out = mix(plain, ["_row"]).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select("_row.*")
