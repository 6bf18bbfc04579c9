"""Hash-chained ledgers: sealing, verification in parallel, roll-ups."""

from __future__ import annotations

import functools
import hashlib
import hmac
import json
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.canon import canonical_sha256, line_hmac, stored_hmac

GENESIS = "0" * 64


#: Lines of a ledger that one task verifies; ranges of line numbers, so that no task holds a ledger.
LINES = 100_000
_SEALED = "ledger_id string, line_no long, raw_line string, prev_hash string, line_hash string"


#: Stand for the marks in a line's text until they are known.
_PREV, _OWN = "<prev_hash of this line>", "<line_hash of this line>"


def _parts(entry: dict) -> tuple[str, str, str]:
    """The canonical line around its two marks: before line_hash, from there to prev_hash, and the rest."""
    text = json.dumps(entry | {"prev_hash": _PREV, "line_hash": _OWN}, sort_keys=True, ensure_ascii=False)
    own, prev = f'"line_hash": "{_OWN}", ', f'"prev_hash": "{_PREV}"'
    if text.count(_OWN) == 1 and text.count(_PREV) == 1:
        head, rest = text.split(own)
        return head, *rest.split(prev)
    # an entry that says the same: where the marks stand is found with names that it hasn't
    own, prev = secrets.token_hex(32), secrets.token_hex(32)
    head, rest = json.dumps(entry | {"prev_hash": prev, "line_hash": own}, sort_keys=True, ensure_ascii=False).split(f'"line_hash": "{own}", ')
    return head, *rest.split(f'"prev_hash": "{prev}"')


def _sealed(batches: Iterator[pa.RecordBatch], key: bytes, numbered: bool = True) -> Iterator[pa.RecordBatch]:
    """Lines (ledger_id, line_no, body, head) by ledger and number, sealed one after the other; only the last mark is kept between batches.

    Lines that aren't numbered have the number before the ledger's first one as line_no, and are numbered as they come.
    """
    ledger, before, last = object(), "", 0
    for batch in batches:
        texts, prevs, marks, numbers = [], [], [], []
        for name, number, body, head in zip(*(batch.column(c).to_pylist() for c in ("ledger_id", "line_no", "body", "head"))):
            if name != ledger:
                ledger, before, last = name, head, number
            last += 1
            start, middle, end = _parts(json.loads(body))
            after = f'{middle}"prev_hash": "{before}"{end}'
            mark = hmac.digest(key, (start + after).encode(), "sha256").hex()
            texts.append(f'{start}"line_hash": "{mark}", {after}')
            prevs.append(before)
            marks.append(mark)
            numbers.append(number if numbered else last)
            before = mark
        made = [pa.array(x, pa.string()) for x in (texts, prevs, marks)]
        yield pa.RecordBatch.from_arrays([batch.column("ledger_id"), pa.array(numbers, pa.int64()), *made], names=["ledger_id", "line_no", "raw_line", "prev_hash", "line_hash"])


def seal(entries: DataFrame, key: bytes, after: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """(ledger_id, line_no, body JSON) -> the same with raw_line, prev_hash and line_hash.

    A chain is sequential, so a ledger's lines pass through one task, sorted (Spark spills the sort) and batch by batch; no task
    holds a ledger. ``after`` has the heads (ledger_id, head, last_line) that the new lines follow; a ledger without one begins anew.
    With ``order`` entries have no line_no: they are numbered from 1 on in the order of these columns, in the same sort.
    """
    lines = entries.withColumn("line_no", F.lit(0).cast("long") if order else F.col("line_no").cast("long"))
    by = order or ["line_no"]
    if after is None:
        lines = lines.withColumn("head", F.lit(GENESIS))
    else:
        known = lines.join(after.select("ledger_id", "head", "last_line"), "ledger_id", "left")
        lines = known.withColumn("line_no", F.col("line_no") + F.coalesce("last_line", F.lit(0))).withColumn("head", F.coalesce("head", F.lit(GENESIS)))
    # equal numbers: by what they say, so that a retried task gives the same chain
    placed = lines.select("ledger_id", "line_no", "body", "head", *order or []).repartition("ledger_id").sortWithinPartitions("ledger_id", *by, "body")
    return placed.mapInArrow(functools.partial(_sealed, key=key, numbered=not order), _SEALED)


def verify(lines: DataFrame, key: bytes, most: int = LINES, counted: bool = False) -> DataFrame:
    """Per ledger (ledger_id, line_no, raw_line): ok, the first bad line and its audit_id. No fold: each line holds its predecessor's hash.

    A ledger is cut into ranges of ``most`` line numbers, each verified by itself in sorted order; then the first line of a range is held
    against the last one of the range before, which takes a row for each range. Line numbers that repeat are in the order of their texts,
    so all but the first of them are bad. The HMAC is taken in the JVM; only lines whose bytes don't give their mark go to
    Python, where they are read as JSON. ``counted`` adds n_lines, so that nobody has to make the lines a second time to count them.
    """
    field = lambda name: F.get_json_object("raw_line", f"$.{name}").alias(name)
    got = lines.select("ledger_id", "line_no", "raw_line", F.floor(F.col("line_no") / most).alias("part"), field("prev_hash"), field("line_hash"), field("audit_id"))
    got = got.withColumn("own", F.coalesce(stored_hmac(F.col("raw_line"), key) == F.col("line_hash"), F.lit(False)))
    other = line_hmac(F.when(~F.col("own"), F.col("raw_line")), key)
    got = got.withColumn("own", F.col("own") | F.coalesce(other == F.col("line_hash"), F.lit(False)))
    order = Window.partitionBy("ledger_id", "part").orderBy("line_no", "raw_line")
    got = got.withColumn("number", F.row_number().over(order)).withColumn("follows", F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("line_hash").over(order), F.lit(GENESIS))))
    bad = F.when(~F.col("own") | ((F.col("number") > 1) & ~F.col("follows")), F.struct("line_no", "audit_id"))
    place = F.struct("line_no", "number")
    parts = got.groupBy("ledger_id", "part").agg(
        F.min(bad).alias("inner"), F.min_by(F.struct("line_no", "audit_id"), place).alias("first"), F.min_by("prev_hash", place).alias("prev_hash"), F.max_by("line_hash", place).alias("last_hash"), F.count(F.lit(1)).alias("n"),
    )
    border = F.coalesce(F.lag("last_hash").over(Window.partitionBy("ledger_id").orderBy("part")), F.lit(GENESIS))
    judged = parts.withColumn("bad", F.least("inner", F.when(~F.col("prev_hash").eqNullSafe(border), F.col("first"))))
    out = judged.groupBy("ledger_id").agg(F.min("bad").alias("bad"), F.sum("n").alias("n_lines"))
    out = out.select("ledger_id", F.col("bad.line_no").alias("first_bad"), F.col("bad.audit_id").alias("first_bad_id"), F.col("bad").isNull().alias("ok"), *["n_lines"] * counted)
    return out.withColumn("status", F.when(F.col("ok"), "VERIFIED").otherwise(F.concat(F.lit("TAMPERED at line "), F.col("first_bad"))))


def record_findings(findings: DataFrame, key: bytes, after: DataFrame | None = None) -> DataFrame:
    """A sealed line for each finding that wasn't refused, drafts included, in the ledger of its case.

    findings: the rows of ``gate.evaluate_claims`` with case_id and hypothesis (and reason_codes, if known). The finding's canonical JSON
    and its hash go into the entry. A later promotion is a new line; nothing is changed.
    """
    kept = findings.filter("refusal is null")
    payload = F.struct(
        "hypothesis", "tier", "audit_ids", "families", F.col("n_families").alias("n_distinct_families"), "confirmation_basis",
        F.col("reason_codes") if "reason_codes" in findings.columns else F.array().cast("array<string>").alias("reason_codes"), "demoted_for_tamper", "demoted_for_temporal", "c_scale",
    )
    hashed = kept.withColumn("finding", payload).withColumn("hash", canonical_sha256(F.to_json("finding", {"ignoreNullFields": "false"})))
    args = F.struct("hypothesis", "audit_ids", F.coalesce("n_signals", F.lit(0)).alias("deception_signal_count"))
    body = F.struct(
        F.concat("case_id", F.lit("-finding-"), F.substring(F.sha2(F.concat_ws(":", F.col("claim_id").cast("string"), "hash"), 256), 1, 16)).alias("audit_id"), "case_id", F.lit("claim_finding").alias("tool"),
        args.alias("args"), F.struct("finding").alias("input_ref"), F.col("hash").alias("pre_sanitization_sha256"), F.col("hash").alias("post_sanitization_sha256"), F.size("audit_ids").alias("rowcount"),
    )
    entries = hashed.select(F.col("case_id").alias("ledger_id"), "claim_id", "hash", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
    return seal(entries, key, after, order=["claim_id", "hash"])


def heads(lines: DataFrame) -> DataFrame:
    return lines.groupBy("ledger_id").agg(F.max_by("line_hash", "line_no").alias("head"), F.max("line_no").alias("last_line"))


def duplicate_ids(calls: DataFrame) -> DataFrame:
    return calls.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(payloads: DataFrame, calls: DataFrame) -> DataFrame:
    """Payload rows whose audit_id no call has."""
    return payloads.join(calls.select("audit_id"), "audit_id", "left_anti")


def case_rollup(calls: DataFrame) -> DataFrame:
    evidence = F.col("tool") != "claim_finding"
    return calls.groupBy("case_id").agg(F.count_if(evidence).alias("n_calls"), F.count_if(~evidence).alias("n_findings"), F.sum("row_count").alias("n_rows"))


def family_matrix(calls: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Per case: was each family called at all? calls (case_id, family)."""
    wide = calls.groupBy("case_id").pivot("family", list(families)).count()
    return wide.select("case_id", *[F.coalesce(F.col(f"`{f}`") > 0, F.lit(False)).alias(f) for f in families])


def event_bounds(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id", "tool").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_event_ts"), F.max("ts").alias("last_event_ts"))
