"""Canonical JSON and keyed hashes: the one place where bytes must be those of a sorted JSON dump, so an Arrow UDF."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that may not stand in a path segment.
_SEGMENT_BANNED = "\u202e\u2066\u200b\u200c\u200d\ufeff"


def canonical(text: str) -> str:
    """A JSON document with sorted keys, ", " and ": " between, and non-ASCII kept."""
    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_sha256(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(canonical(t).encode()).hexdigest(), na_action="ignore")


def line_hmac(entry: Column, key: bytes) -> Column:
    """HMAC-SHA-256 over the canonical entry (JSON text) without its line_hash."""

    @F.pandas_udf(T.StringType())
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str) -> str:
            body = {k: v for k, v in json.loads(text).items() if k != "line_hash"}
            return hmac.new(key, json.dumps(body, sort_keys=True, ensure_ascii=False).encode(), hashlib.sha256).hexdigest()

        for part in texts:
            yield part.map(one, na_action="ignore")

    return signed(entry)


@F.pandas_udf(T.BooleanType())
def safe_segment(values: pd.Series) -> pd.Series:
    """May the value be one segment of a path? Checked as it is and in compatibility form."""

    def ok(v: str | None) -> bool:
        if not v:
            return False
        return all(not (".." in f or f[:1] in "./\\" or "/" in f or "\\" in f or any(ord(c) < 32 or ord(c) == 127 or c in _SEGMENT_BANNED for c in f)) for f in (v, unicodedata.normalize("NFKC", v)))

    return values.map(ok)


#: The HMAC's block, in bytes.
_BLOCK = 64


def _padded(key: bytes, pad: int) -> bytes:
    known = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    return bytes(b ^ pad for b in known.ljust(_BLOCK, b"\0"))


def stored_hmac(line: Column, key: bytes) -> Column:
    """The HMAC-SHA-256 of a line's own bytes without its line_hash, in the JVM; null where the mark isn't there exactly once.

    Sealed lines are canonical JSON, so for them this is ``line_hmac``; a line that was written in another way differs from
    it, and needs ``line_hmac``. The key's pads are literals of the plan: don't show plans of ledgers' keys.
    """
    mark = '"line_hash": "[0-9a-f]{64}", '
    body = F.when(F.regexp_count(line, F.lit(mark)) == 1, F.regexp_replace(line, mark, "")).cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.lit(_padded(key, 0x36)), body), 256))
    return F.sha2(F.concat(F.lit(_padded(key, 0x5C)), inner), 256)
