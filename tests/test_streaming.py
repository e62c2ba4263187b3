"""Streams against the same steps in batch."""

import json

from pyspark.sql import functions as F

from tessera.streaming import jobs, requests


def record(k, **more):
    return json.dumps({"correlationId": k, "binWidth": 10, "binHeight": 5, "parts": [{"itemId": "a", "svgUrl": "u", "amountOfParts": 2}]} | more)


def test_parse(spark):
    rows = [record("a"), record("b", binWidth=None), record("c", parts=None), json.dumps({"correlationId": "d", "cancelled": True}), record("e", amountOfParts=-4, amountOfRotations=None), json.dumps({"binWidth": 1}), "no json"]
    got = requests.parse(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r.error for r in got] == [None, "bin is missing", "no parts", None, None, "correlationId is missing", "correlationId is missing"]
    assert got[4].amount == 0 and got[4].rotations == 8 and got[3].cancelled


def test_cancelled_and_served(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text(json.dumps({"correlationId": "x", "cancelled": True}) + "\n" + record("y") + "\n")
    stream = jobs.without_cancelled(jobs.files(spark, str(tmp_path / "in"), 1))
    answers, retries = [], []

    def pack(df):
        bad = F.col("correlation_id") == "z"
        return df.select("correlation_id", F.size("parts").alias("n"), bad.alias("failed"), F.lit(True).alias("retryable"), F.lit(None).cast("int").alias("attempt"), F.lit("req").alias("topic"))

    def run():
        jobs.serve(stream, pack, lambda d, n: answers.extend(r.key for r in d.collect()), lambda d, n: retries.extend((r.correlation_id, r.next_topic) for r in d.collect()), str(tmp_path / "check")).awaitTermination(120)

    run()
    assert answers == ["y"]
    (tmp_path / "in/2.txt").write_text(record("x") + "\n" + record("z") + "\n" + record("w", binHeight=0) + "\n")
    run()
    assert sorted(answers) == ["w", "y"] and retries == [("z", "req.retry.1")]


def test_backoff():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    jobs.with_backoff(call, first=0.001)
    assert len(tries) == 3


def test_watermark(spark):
    rows = [(0, 0, True), (0, 1, True), (0, 2, False), (0, 3, True), (1, 5, True), (1, 6, True), (2, 0, False)]
    got = requests.watermark(spark.createDataFrame(rows, "part long, pos long, done boolean")).collect()
    assert {r.part: (r.commit, r.pending) for r in got} == {0: (2, 1), 1: (7, 0), 2: (0, 0)}


class Clock:
    """A group's state with a clock set by hand."""

    def __init__(self):
        self.now, self.value, self.hasTimedOut = 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        assert ms > 0


def test_requests_do_not_renew_a_cancellation():
    import pandas as pd

    clock = Clock()
    one = lambda cancel: next(iter(jobs._cancel(("k",), iter([pd.DataFrame({"id": ["k"], "value": ["v"], "cancel": [cancel]})]), clock, 300)), None)
    assert one(True) is None
    for at, dropped in ((100, True), (299, True), (301, False), (500, False)):
        clock.now = at * 1000
        assert one(False)["dropped"].tolist() == [dropped]


def test_records_wait_in_their_tier():
    import pandas as pd

    clock = Clock()
    clock.now = 10_000
    frame = pd.DataFrame({"value": ["a", "b"], "attempt": [2, 3], "topic": ["t", "t"], "delay_s": [5, 60], "at": pd.to_datetime([10, 10], unit="s")})
    out = lambda frames: [r for f in jobs._hold(("k",), iter(frames), clock) for r in f["value"]]
    assert out([frame]) == [] and len(clock.value[0]) == 2
    clock.hasTimedOut = True
    for now, due in ((14_999, []), (15_000, ["a"]), (69_000, []), (70_000, ["b"])):
        clock.now = now
        assert out([]) == due
    assert clock.value is None
