"""Packing requests as records: parsing, cancellation, retries and commit positions.

Each step is a transformation of a DataFrame, batch or stream alike; jobs.py wires them to
sources and sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The request's fields, the retry ladder, the life of a cancellation.
REQUEST = """correlationId string, svgBase64 string, svgUrl string, binWidth double, binHeight double, spacing double, amountOfParts long,
 parts array<struct<itemId: string, svgUrl: string, amountOfParts: long, allowedRotations: array<double>>>, amountOfRotations long, outputQueueUrl string,
 cancelled boolean, maxFit boolean, bucket string, s3Prefix string, maxSeconds long,
 offcutPolicy struct<minOffcutWidthMm: double, minOffcutHeightMm: double, shape: string, kerfMm: double>"""
ROTATIONS, BUDGET, DELAYS, TTL = 8, 3, (5, 60, 600), 300


def parse(records: DataFrame, value: str = "value") -> DataFrame:
    """records with the request's fields and `error`, null for a valid one. JSON null is absence; negative counts are 0."""
    out = records.withColumn("r", F.from_json(F.col(value), REQUEST))
    r = F.col("r")
    count = F.greatest(F.coalesce(r["amountOfParts"], F.lit(0)), F.lit(0))
    parts = F.coalesce(r["parts"], F.array().cast("array<struct<itemId:string,svgUrl:string,amountOfParts:bigint,allowedRotations:array<double>>>"))
    cancelled = F.coalesce(r["cancelled"], F.lit(False))
    bad = F.when(r["correlationId"].isNull(), "correlationId is missing").when(cancelled, None).when((F.coalesce(r["binWidth"], F.lit(0.0)) <= 0) | (F.coalesce(r["binHeight"], F.lit(0.0)) <= 0), "bin is missing").when((F.size(parts) == 0) & (count == 0), "no parts")
    return out.select(*records.columns, r["correlationId"].alias("correlation_id"), cancelled.alias("cancelled"), r["binWidth"].alias("bin_width"), r["binHeight"].alias("bin_height"), F.coalesce(r["spacing"], F.lit(0.0)).alias("spacing"), count.alias("amount"), parts.alias("parts"), F.coalesce(r["amountOfRotations"], F.lit(ROTATIONS)).alias("rotations"), F.coalesce(r["maxFit"], F.lit(False)).alias("max_fit"), r["offcutPolicy"].alias("offcut_policy"), bad.alias("error"))


def peek_cancelled(value: Column) -> Column:
    """The correlation id of a cancellation, else null, without parsing the whole."""
    return F.when(F.get_json_object(value, "$.cancelled") == "true", F.get_json_object(value, "$.correlationId"))


def with_cancellations(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """requests (id, at: seconds, cancel: boolean) -> live requests with `dropped`: a cancellation of the id at most ttl before it."""
    w = Window.partitionBy("id").orderBy("at").rangeBetween(-ttl, 0)
    seen = F.max(F.col("cancel").cast("int")).over(w)
    return requests.withColumn("dropped", F.coalesce(seen == 1, F.lit(False))).where(~F.col("cancel"))


def route(failed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """failed (attempt: null is 1, retryable, topic) -> next attempt, tier topic or null if it is dropped, and its delay."""
    attempt = F.coalesce("attempt", F.lit(1))
    again = F.col("retryable") & (attempt < budget)
    delay = F.element_at(F.array(*map(F.lit, DELAYS)), F.least(attempt, F.lit(len(DELAYS))).cast("int"))
    return failed.withColumn("next_attempt", F.when(again, attempt + 1)).withColumn("next_topic", F.when(again, F.concat("topic", F.lit(".retry."), attempt.cast("string")))).withColumn("delay_s", F.when(again, delay))


def watermark(offsets: DataFrame) -> DataFrame:
    """offsets (part, pos, done) -> per part: the end of the unbroken prefix of done positions, and those done beyond it."""
    first = offsets.groupBy("part").agg(F.min(F.when(~F.col("done"), F.col("pos"))).alias("gap"), F.max("pos").alias("last"), F.sum(F.col("done").cast("long")).alias("n_done"), F.min("pos").alias("first"))
    commit = F.coalesce("gap", F.col("last") + 1)
    return first.select("part", commit.cast("long").alias("commit"), (F.col("n_done") - (commit - F.col("first"))).cast("long").alias("pending"))


def respond(results: DataFrame) -> DataFrame:
    """results as JSON records, fields without a value left out."""
    return results.select(F.col("correlation_id").alias("key"), F.to_json(F.struct(*results.columns)).alias("value"))


#: The names of a record's headers.
ATTEMPT, ORIGIN = "x-cutl-attempt", "x-cutl-origin-topic"


def attempt_of(headers: Column) -> Column:
    """The attempt that a record's headers (array of key, binary value) name; the first if they name none or no number."""
    own = F.filter(headers, lambda h: h["key"] == ATTEMPT)
    return F.greatest(F.coalesce(F.get(own, F.lit(0))["value"].cast("string").try_cast("int"), F.lit(1)), F.lit(1))


def origin_of(headers: Column, topic: Column) -> Column:
    """The topic a retried record came from at first; its own without that header."""
    own = F.filter(headers, lambda h: h["key"] == ORIGIN)
    return F.coalesce(F.get(own, F.lit(0))["value"].cast("string"), topic)


def retry_headers(attempt: Column, origin: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in ((ATTEMPT, attempt), (ORIGIN, origin))])


def improvements(runs: DataFrame) -> DataFrame:
    """runs (correlation_id, wave, parts_placed, utilisation) -> those better than all former ones, the last of each marked final: the messages of a request under way."""
    before = Window.partitionBy("correlation_id").orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)
    score = F.struct("parts_placed", "utilisation")
    better = runs.withColumn("_best", F.max(score).over(before)).where(F.col("_best").isNull() | (score > F.col("_best"))).drop("_best")
    last = Window.partitionBy("correlation_id").orderBy(F.desc("wave"))
    return better.withColumn("final", F.row_number().over(last) == 1).withColumn("improvement", ~F.col("final"))
