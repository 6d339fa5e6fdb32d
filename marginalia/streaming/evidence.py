"""Late evidence in a stream: a state for each claim that judgements and retractions change in any order.

A log of records comes in batches: evidence (a verdict on a claim) and retractions (which withdraw a
record of the same claim). What a claim is, Unknown, Answered or Contested, follows from the evidence
that stands; it is not monotone, since later evidence contradicts and later retractions withdraw.

State of a claim: two counts of standing evidence and the least place of each verdict ever seen (four
numbers), and the records of the last `horizon` of event time, by id. Within the horizon a record
that comes again is no news, and a retraction finds its record or waits for it. A timer folds a
record into the counts once the watermark is `horizon` past it, and forgets its id; from then on it
stands or is withdrawn for good. What comes behind the watermark is dropped by Spark, so a folded
record that comes again is never counted twice. So the state holds, for each claim, four numbers and
as many ids as it has records within the horizon, however long the stream runs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Records of the log: kind is evidence or retraction; id names evidence, or what a retraction withdraws; seq is the place in the log.
LOG = "claim bigint, kind string, id bigint, seq bigint, against boolean, at timestamp"
CHANGES = "claim bigint, version bigint, speaks_for bigint, speaks_against bigint, since bigint, was string, state string"
#: Records of a claim that are held in memory at once.
AT_ONCE = 20_000
#: Records of a bucket, and by how much buckets multiply where one overflows.
IN_BUCKET, SPREAD = 2048, 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def label(n_for: int, n_against: int) -> str:
    return "Contested" if n_for and n_against else "Answered" if n_for or n_against else "Unknown"


class Claims(StatefulProcessor):
    """One claim's records to its changes of state. horizon: milliseconds.

    Every call to the state is a round trip between Python and the JVM, so records are packed, up to
    IN_BUCKET in a value: a claim's records are in one bucket by id until that overflows, then in
    SPREAD times as many. A claim has one timer at a time, the next that is due.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # standing and least place by verdict (0 for, 1 against), the number of changes told, of buckets, and the next timer
        self.sums = handle.getValueState("sums", "n0 bigint, n1 bigint, first0 bigint, first1 bigint, version bigint, buckets bigint, timer bigint")
        self.recent = handle.getMapState("recent", "bucket bigint", "packed binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n0, n1, first0, first1, version, buckets, timer = self.sums.get() or (0, 0, None, None, 0, 1, None)
        n, first = [n0, n1], [first0, first1]
        before, was, held = (*n, *first), label(*n), (buckets, timer)
        while some := list(islice(rows, AT_ONCE)):  # a claim may have very many records in a batch
            touched: dict[int, dict[int, tuple]] = {}
            for _, id_, seq, retracts, verdict, _, ms in some:
                number = bucket_of(id_, buckets)
                bucket = touched.get(number)
                if bucket is None:
                    bucket = touched[number] = self._bucket(number)
                against, withdrawn, until = bucket.get(id_) or (None, False, 0)
                if not retracts:
                    place = int(verdict)
                    first[place] = seq if first[place] is None else min(first[place], seq)
                    if against is None:  # else it is no news
                        against = place
                        n[place] += not withdrawn
                elif not withdrawn:
                    withdrawn = True
                    if against is not None:
                        n[against] -= 1
                bucket[id_] = (against, withdrawn, max(until, self.until(ms)))
                if timer is None or bucket[id_][2] < timer:
                    timer = bucket[id_][2]
            for number, bucket in touched.items():
                self.recent.updateValue((number,), (packed(bucket),))
            while max(map(len, touched.values())) > IN_BUCKET:
                buckets *= SPREAD
                touched = self._spread(buckets)
        if timer != held[1]:
            self.handle.registerTimer(timer)
        changed = (*n, *first) != before
        version += changed
        if changed or (buckets, timer) != held:
            self.sums.update((*n, *first, version, buckets, timer))
        if changed:
            since = None if None in first else max(first)
            yield Row(claim=key[0], version=version, speaks_for=n[0], speaks_against=n[1], since=since, was=was, state=label(*n))

    def until(self, ms: int) -> int:
        """When a record of time ms is folded: the horizon later, rounded up, so that many records share a timer."""
        step = max(1, self.horizon // 64)
        return -(-(ms + self.horizon) // step) * step

    def _bucket(self, number: int) -> dict[int, tuple]:
        found = self.recent.getValue((number,))
        return unpacked(found[0]) if found else {}

    def _spread(self, buckets: int) -> dict[int, dict[int, tuple]]:
        """The claim's records in so many buckets; those of one old bucket go to new ones of their own, so one is in memory at a time but for the sizes."""
        last: dict[int, dict[int, tuple]] = {}
        for number in range(buckets // SPREAD):
            parts: dict[int, dict[int, tuple]] = {}
            for id_, record in self._bucket(number).items():
                parts.setdefault(bucket_of(id_, buckets), {})[id_] = record
            self.recent.removeKey((number,))
            for k, part in parts.items():
                self.recent.updateValue((k,), (packed(part),))
            last = max(last, parts, key=lambda p: max(map(len, p.values()), default=0))
        return last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The counts have what stands; the ids whose time has come go, and the next timer is set."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        *sums, buckets, _ = self.sums.get()
        timer = None
        for number in range(buckets):
            bucket = self._bucket(number)
            left = {id_: record for id_, record in bucket.items() if record[2] > now}
            if left:
                timer = min(record[2] for record in left.values()) if timer is None else min(timer, *(record[2] for record in left.values()))
            if bucket and not left:
                self.recent.removeKey((number,))
            elif len(left) < len(bucket):
                self.recent.updateValue((number,), (packed(left),))
        if timer is not None:
            self.handle.registerTimer(timer)
        self.sums.update((*sums, 1 if timer is None else buckets, timer))
        return iter(())

    def close(self) -> None:
        pass


def bucket_of(id_: int, buckets: int) -> int:
    return (id_ * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFFFFF) % buckets if buckets > 1 else 0


def packed(records: dict[int, tuple]) -> bytes:
    """Records (verdict or None, withdrawn, until) by id: 17 bytes each."""
    ids, flags = array("q", records), bytes((2 if a is None else a) + 4 * w for a, w, _ in records.values())
    return ids.tobytes() + array("q", [until for _, _, until in records.values()]).tobytes() + flags


def unpacked(data: bytes) -> dict[int, tuple]:
    n, ids, untils = len(data) // 17, array("q"), array("q")
    ids.frombytes(data[: 8 * n])
    untils.frombytes(data[8 * n : 16 * n])
    return {id_: (None if f & 3 == 2 else f & 3, f >= 4, until) for id_, until, f in zip(ids, untils, data[16 * n :])}


def evidence_log(records: DataFrame, claim: Column, id_: Column, against: Column, at: Column, withdrawn: Column, later: str = "1 hour") -> DataFrame:
    """A table as a log: a row of evidence for each of its rows, and a retraction, `later` in event time, of those that are withdrawn."""
    rows = records.select(claim.cast("long").alias("claim"), id_.cast("long").alias("id"), against.cast("boolean").alias("against"), at.cast("timestamp").alias("at"), withdrawn.alias("_gone"))
    evidence = rows.select("claim", F.lit("evidence").alias("kind"), "id", F.col("id").alias("seq"), "against", "at")
    gone = rows.where("_gone").select("claim", F.lit("retraction").alias("kind"), "id", F.col("id").alias("seq"), F.lit(None).cast("boolean").alias("against"), (F.col("at") + F.expr(f"interval {later}")).alias("at"))
    return evidence.union(gone)


def claim_states(log: DataFrame, horizon: str, late: str) -> DataFrame:
    """A stream of LOG to a stream of CHANGES: one row for each claim and batch that changed it.

    Rows without a claim, an id or a time say nothing and are left out, as is evidence without a
    verdict. late: how far behind the newest record one may come; horizon: how long after its
    record a retraction or a repetition finds it.
    """
    rows = log.where("claim is not null and id is not null and at is not null and (kind = 'retraction' or kind = 'evidence' and against is not null)")
    spark = log.sparkSession
    ms = spark.sql(f"select unix_millis(timestamp_seconds(0) + interval {horizon})").first()[0]
    rows = rows.select("claim", "id", "seq", (F.col("kind") == "retraction").alias("retracts"), "against", "at", F.unix_millis("at").alias("ms"))
    return rows.withWatermark("at", late).groupBy("claim").transformWithState(Claims(ms), CHANGES, "Update", "EventTime")


def run_claims(log: DataFrame, target: str, checkpoint: str, horizon: str = "30 days", late: str = "30 days") -> StreamingQuery:
    """Writes the changes under target, a folder for each batch (one that runs again replaces its own), for what is there now, then ends. Started again with the same checkpoint it goes on."""
    spark: SparkSession = log.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)  # the query takes its settings when it starts; the session's are put back
    try:
        changes = claim_states(log, horizon, late)

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each claim."""
    fields = [c for c in ("speaks_for", "speaks_against", "since", "state")]
    return changes.groupBy("claim").agg(F.max_by(F.struct(*fields), "version").alias("s")).select("claim", *[f"s.{c}" for c in fields])
