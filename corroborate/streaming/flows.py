"""Streaming forms of the append-only operators. Each has a batch twin that it must agree with."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corroborate.operators import gate, textguard
from corroborate.operators.ledger import GENESIS
from corroborate.sources import artifacts


def running_corroboration(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Families and tier of each case, program and window of a stream (case_id, tool, program_path, ts); later rows are dropped."""
    known = events.join(gate.tools(events.sparkSession), "tool").withWatermark("ts", late)
    out = known.groupBy("case_id", F.lower("program_path").alias("program"), F.window("ts", window)).agg(F.array_sort(F.collect_set("family")).alias("families"))
    return out.withColumn("tier", gate.tier_name(gate.tier_rank(F.size("families"))))


def claims_against(stream: DataFrame, calls: Callable[[], DataFrame], out: str, checkpoint: str, window_seconds: float = 5.0) -> StreamingQuery:
    """Evaluates each batch of claims against the calls as they are then; a batch is written to its own folder, so a retry replaces it."""

    def one(batch: DataFrame, number: int) -> None:
        gate.evaluate_claims(batch, calls(), window_seconds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guarded_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """New sidecar files -> valid events, whose paths passed the text guard, and quarantine, a folder for each batch.

    Quarantine holds rejected events and, without a row_index, rejected envelopes.
    """
    lines = spark.readStream.schema(artifacts.ENVELOPE).option("multiLine", True).option("recursiveFileLookup", "true").json(folder).withColumn("path", F.col("_metadata.file_path"))

    def one(batch: DataFrame, number: int) -> None:
        docs = batch.withColumn("case_id", F.regexp_extract("path", artifacts.CASE, 1)).withColumn("expected_tool", artifacts._by_place(F.col("path"), 1)).withColumn("expected_family", artifacts._by_place(F.col("path"), 2))
        fit, unfit = artifacts.check_envelopes(docs)
        ok, bad = artifacts.check_events(artifacts.explode_events(fit))
        guarded, _ = textguard.sanitize(ok, "program_path")  # check_events has rejected paths over 4 096 characters
        ok = guarded.withColumn("program_path", F.col("clean_text")).drop("clean_text")
        unfit = unfit.select("case_id", "tool", F.col("path").alias("source_artifact"), F.lit(None).cast("int").alias("row_index"), "reason")
        bad = bad.select("case_id", "tool", "source_artifact", "row_index", "reason").unionByName(unfit)
        ok.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def typed_state(spark: SparkSession) -> None:
    """Operators with typed state keep it in RocksDB; Spark takes the setting from the session when a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Tail(StatefulProcessor):
    """A ledger's head and the number of its next line, lines that wait for a gap to close, and the digests of lines already verified."""

    def __init__(self, key: bytes, first: int):
        self.key, self.begin = key, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "head string, next long, bad long, bad_id string, waits long")
        self.waiting = handle.getMapState("waiting", "line_no long", "raw_line string")
        self.seen = handle.getMapState("seen", "line_no long", "digest string")

    def _judge(self, text: str, head: str | None) -> tuple[str | None, str | None, bool]:
        """(the line's mark, its audit_id, is it the sealed successor of head)."""
        try:
            entry = json.loads(text)
            mark = entry.pop("line_hash", None)
            own = hmac.new(self.key, json.dumps(entry, sort_keys=True, ensure_ascii=False).encode(), hashlib.sha256).hexdigest()
            return mark, entry.get("audit_id"), mark == own and entry.get("prev_hash") == (GENESIS if head is None else head)
        except (TypeError, ValueError, AttributeError):
            return None, None, False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, following, bad, bad_id, waits = self.at.get() if self.at.exists() else (GENESIS, self.begin, None, None, 0)
        digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()

        def worse(number: int, text: str) -> None:
            nonlocal bad, bad_id
            if bad is None or number < bad:
                bad, bad_id = number, self._judge(text, None)[1]

        fresh: dict[int, str] = {}
        for part in rows:
            for number, text in zip(part["line_no"].tolist(), part["raw_line"].tolist()):
                if number < following:
                    kept = self.seen.getValue((number,))[0] if self.seen.containsKey((number,)) else None
                    if kept != digest(text):
                        worse(number, text)
                elif number in fresh:
                    if fresh[number] != text:
                        worse(number, text)
                else:
                    fresh[number] = text
        # of the lines that wait, those that are asked for, one by one
        while True:
            kept = self.waiting.getValue((following,))[0] if waits and self.waiting.containsKey((following,)) else None
            if kept is None and following not in fresh:
                break
            text = fresh.pop(following, kept)
            if kept is not None:
                self.waiting.removeKey((following,))
                waits -= 1
                if kept != text:
                    worse(following, text)
            mark, _, good = self._judge(text, head)
            if not good:
                worse(following, text)
            self.seen.updateValue((following,), (digest(text),))
            head, following = mark, following + 1
        for number, text in fresh.items():
            if not self.waiting.containsKey((number,)):
                waits += 1
                self.waiting.updateValue((number,), (text,))
            elif self.waiting.getValue((number,))[0] != text:
                worse(number, text)
        self.at.update((head, following, bad, bad_id, waits))
        last, verified = following - 1, following - 1
        for number in sorted(n[0] for n in self.waiting.keys()) if waits else []:
            # what the lines so far say, while the gap is open; nothing of it stays in state
            last = number
            if bad is None:
                text = self.waiting.getValue((number,))[0]
                head, name, good = self._judge(text, head)
                bad, bad_id = (bad, bad_id) if good else (number, name)
        yield pd.DataFrame({
            "ledger_id": [key[0]], "last_line": [last], "first_bad": pd.array([bad], dtype="Int64"), "ok": [bad is None], "first_bad_id": pd.array([bad_id], dtype="string"), "verified_to": [verified], "waiting": [waits],
        })


def ledger_tail(lines: DataFrame, key: bytes, first: int = 1) -> DataFrame:
    """Verification of growing ledgers (ledger_id, line_no, raw_line), in update mode: a row says what ``ledger.verify`` says of the lines so far.

    Lines come in any order. A line beyond a gap waits in state and is verified for good when the gap closes; while it is open
    (``waiting`` lines beyond ``verified_to``), the line behind it counts as bad, which a later row takes back.
    A line that comes again must be the line that came before, byte by byte; a changed one is bad, so the digest of every line
    stays in state (RocksDB keeps it on disk). Lines are numbered from ``first``.
    """
    typed_state(lines.sparkSession)
    return lines.select("ledger_id", "line_no", "raw_line").groupBy("ledger_id").transformWithStateInPandas(
        _Tail(key, first), "ledger_id string, last_line long, first_bad long, ok boolean, first_bad_id string, verified_to long, waiting long", "Update", "None"
    )


_CHANGE = "case_id string, program string, at timestamp, families array<string>, old_rank int, rank int"


class _Changes(StatefulProcessor):
    """The families of a (case, program) that were told, and the first times of those that the watermark hasn't passed yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "families array<string>, rank int")
        self.first = handle.getMapState("first", "family string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = self.told.get()[0] if self.told.exists() else []
        for part in rows:
            for family, at in part.groupby("family")["at"].min().items():
                known = self.first.getValue((family,))[0] if self.first.containsKey((family,)) else None
                if family not in told and (known is None or at < known):
                    self.first.updateValue((family,), (int(at),))
                    self.handle.registerTimer(-(-int(at) // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((at[0], family[0]) for family, at in self.first.iterator() if at[0] <= passed)
        if not ready:
            yield pd.DataFrame()
            return
        families, rank = self.told.get() if self.told.exists() else ([], None)
        families, out = list(families), []
        for at in sorted({a for a, _ in ready}):
            families = sorted({*families, *(f for a, f in ready if a == at)})
            old, rank = rank, min(len(families), gate.MOST_RANK)
            if rank != old:
                out.append((key[0], key[1], pd.Timestamp(at, unit="us"), families, old, rank))
        for _, family in ready:
            self.first.removeKey((family,))
        self.told.update((families, rank))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGE.split(", ")])
        yield frame.astype({"old_rank": "Int32", "rank": "Int32"})


def _first_times(events: DataFrame) -> DataFrame:
    known = events.join(gate.tools(events.sparkSession), "tool")
    return known.select("case_id", F.lower("program_path").alias("program"), "family", "ts")


def _named(changes: DataFrame) -> DataFrame:
    names = [gate.tier_name(F.col(c)).alias(n) for c, n in (("old_rank", "old_tier"), ("rank", "tier"))]
    return changes.select("case_id", "program", "at", "families", *names)


def tier_changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each change of a program's tier on a case, from a stream (case_id, tool, program_path, ts): append mode, once the watermark has passed it.

    State holds a program's families, a handful: those that were told, and the first times of the others, which rows that come
    late may still lower. Nothing comes out while the tier stays. Rows behind the watermark are dropped; unknown tools stay out.
    """
    typed_state(events.sparkSession)
    rows = _first_times(events.withWatermark("ts", late)).withColumn("at", F.unix_micros("ts"))
    return _named(rows.groupBy("case_id", "program").transformWithStateInPandas(_Changes(), _CHANGE, "Append", "EventTime"))


def tier_changes_batch(events: DataFrame) -> DataFrame:
    """The same of a table: one row for each time at which a program's tier changes. Windows run over a program's families."""
    first = _first_times(events).groupBy("case_id", "program", "family").agg(F.min("ts").alias("at"))
    so_far = Window.partitionBy("case_id", "program").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    times = first.select("case_id", "program", "at", F.array_sort(F.collect_set("family").over(so_far)).alias("families")).distinct()
    ranked = times.withColumn("rank", gate.tier_rank(F.size("families")))
    before = F.lag("rank").over(Window.partitionBy("case_id", "program").orderBy("at"))
    return _named(ranked.withColumn("old_rank", before).filter(~F.col("rank").eqNullSafe(F.col("old_rank"))))
