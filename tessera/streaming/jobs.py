"""Structured Streaming jobs over requests: cancellation with a time to live, retries, responses."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.requests import TTL, parse, peek_cancelled, respond, route


def kafka(spark: SparkSession, servers: str, topic: str, bound: int = 1000, **options: str) -> DataFrame:
    """Records of a topic; bound: how many a micro-batch takes. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(bound)} | options).load().withColumn("value", F.col("value").cast("string"))


def files(spark: SparkSession, path: str, bound: int = 100) -> DataFrame:
    """One request a line, of the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", bound).text(path)


def _cancel(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ttl: int) -> Iterator[pd.DataFrame]:
    """The state is when the id was cancelled last; requests don't renew it."""
    if state.hasTimedOut:
        state.remove()
        return
    now = state.getCurrentProcessingTimeMs()
    at = state.get[0] if state.exists else None
    for f in frames:
        if f["cancel"].any():
            at = now
        live = f[~f["cancel"]]
        if len(live):
            yield pd.DataFrame({"id": live["id"], "value": live["value"], "dropped": at is not None and now - at <= ttl * 1000})
    if at is not None and now - at < ttl * 1000:
        state.update((at,))
        state.setTimeoutDuration(max(1, at + ttl * 1000 - now))
    elif state.exists:
        state.remove()


def without_cancelled(records: DataFrame, ttl: int = TTL) -> DataFrame:
    """(id, value, dropped): requests, dropped if their id was cancelled in the last ttl seconds. State: one time an id, for ttl seconds.

    Records without an id can't be cancelled; they are dealt by a hash of the whole record.
    """
    id_ = F.get_json_object("value", "$.correlationId")
    key = F.coalesce(id_, F.concat(F.lit("no id "), F.xxhash64("value")))
    keyed = records.select(key.alias("key"), F.coalesce(id_, F.lit("")).alias("id"), "value", peek_cancelled(F.col("value")).isNotNull().alias("cancel"))
    return keyed.groupBy("key").applyInPandasWithState(lambda k, f, s: _cancel(k, f, s, ttl), "id string, value string, dropped boolean", "cancelled long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _hold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Records of one key until their delay has passed; the state has them all, with the time each is due."""
    now = state.getCurrentProcessingTimeMs()
    held = list(state.get[0]) if state.exists else []
    if not state.hasTimedOut:
        for f in frames:
            held += [json.dumps([int(d) * 1000 + now if pd.isna(at) else int(at.timestamp() * 1000) + int(d) * 1000, v, int(a), t]) for v, a, t, d, at in zip(f["value"], f["attempt"], f["topic"], f["delay_s"], f["at"], strict=True)]
    rows = [json.loads(h) for h in held]
    due = [r for r in rows if r[0] <= now]
    if due:
        yield pd.DataFrame({"value": [r[1] for r in due], "attempt": pd.array([r[2] for r in due], "int32"), "topic": [r[3] for r in due]})
    left = [r for r in rows if r[0] > now]
    if left:
        state.update(([json.dumps(r) for r in left],))
        state.setTimeoutDuration(max(1, min(r[0] for r in left) - now))
    elif state.exists:
        state.remove()


def held_back(records: DataFrame) -> DataFrame:
    """Records of retry tiers (key, value, attempt, topic, delay_s, at: when they were sent) come out delay_s after at, in no order of keys."""
    return records.select("key", "value", "attempt", "topic", "delay_s", "at").groupBy("key").applyInPandasWithState(_hold, "value string, attempt int, topic string", "held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_backoff(call: Callable[[], None], attempts: int = 3, first: float = 0.1) -> None:
    """Repeats a failing call after 0.1, 0.2, 0.4 ... seconds."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(first * 2**k)


def serve(records: DataFrame, pack: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], retry: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs pack over each micro-batch's valid requests; answers go to sink, invalid ones as errors, failed ones to retry.

    pack: requests -> rows with correlation_id, and failed, retryable, attempt and topic for those that failed.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = parse(df.where("not dropped")).persist()
        try:
            answers = pack(rows.where("error is null and not cancelled"))
            failed = answers.where(F.coalesce("failed", F.lit(False)))
            with_backoff(lambda: retry(route(failed), n))
            with_backoff(lambda: sink(respond(answers.where(~F.coalesce("failed", F.lit(False))).drop("failed", "retryable", "attempt", "topic")), n))
            with_backoff(lambda: sink(respond(rows.where("error is not null").select("correlation_id", "error")), n))
        finally:
            rows.unpersist()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
