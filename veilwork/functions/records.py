"""Identities and seals of stored records: canonical JSON, versions, encryption.

Canonical JSON must be equal to the byte with what other writers hash, and the
escapes of Spark's own writer differ from theirs. So it is made by Arrow
functions; everything around it stays in the JVM.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Versions of stored records.
VERSIONS = {"audit": 1, "cache": 1, "job": 1, "idempotency": 3}
CACHE_KEY_VERSION = 2
SEAL = "hmac-sha256"


def cache_key(
    text: Column, policy: dict | None = None, entity_types: list[str] | None = None, salt: str = "", shared: bool = False,
    mode: str = "legacy", detector: str = "", model_revision: str = "",
) -> Column:
    """Digest of all that a response depends on; the salt is part of it unless the cache is shared."""
    rest: dict[str, Any] = {
        "cache_version": CACHE_KEY_VERSION, "policy": policy or {}, "entity_types": entity_types or [], "mode": mode,
        "detector": detector, "model_revision": model_revision,
    }
    if not shared:
        rest["salt"] = salt
    return _digest(rest, (", ", ": "))(text)


def fingerprint(text: Column, policy: dict | None = None, entity_types: list[str] | None = None, staged: bool = False) -> Column:
    """Digest of an effective request."""
    return _digest({"entity_types": entity_types or [], "policy": policy or {}, "use_pipeline": staged}, (",", ":"))(text)


def _digest(rest: dict, separators: tuple[str, str]):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        whole = (json.dumps({**rest, "text": t}, sort_keys=True, ensure_ascii=False, separators=separators) for t in texts)
        return pd.Series([hashlib.sha256(w.encode()).hexdigest() for w in whole])

    return run


def sealed(event: Column, key: str) -> Column:
    """An event (JSON text) with the seal of its canonical form."""

    @F.pandas_udf("string")
    def run(events: pd.Series) -> pd.Series:
        out = []
        for e in map(json.loads, events):
            out.append(json.dumps({**e, "integrity": {"algorithm": SEAL, "digest": _seal(e, key)}}, separators=(",", ":"), sort_keys=True))
        return pd.Series(out)

    return run(event)


def intact(event: Column, key: str) -> Column:
    """Whether an event (JSON text) has the seal that its other fields call for."""

    @F.pandas_udf("boolean")
    def run(events: pd.Series) -> pd.Series:
        return pd.Series([_intact(e, key) for e in events])

    return run(event)


def _seal(event: dict, key: str) -> str:
    return hmac.new(key.encode(), json.dumps(event, separators=(",", ":"), sort_keys=True).encode(), hashlib.sha256).hexdigest()


def _intact(text: str | None, key: str) -> bool:
    try:
        event = json.loads(text or "")
        seal = event.pop("integrity")
        return seal["algorithm"] == SEAL and hmac.compare_digest(seal["digest"], _seal(event, key))
    except (ValueError, KeyError, TypeError, AttributeError):
        return False


def opened_envelope(raw: Column, kind: str = "cache") -> Column:
    """The response in a stored envelope (JSON text); null if it cannot be read or is of another version."""
    parsed = F.from_json(raw, "struct<schema_version:string,response:string>", {"mode": "PERMISSIVE"})
    response = parsed["response"]
    return F.when((parsed["schema_version"] == str(VERSIONS[kind])) & response.startswith("{"), response)


def encrypted(payload: Column, key: bytes) -> Column:
    """A job's payload, unreadable without the key (16, 24 or 32 bytes)."""
    return F.base64(F.aes_encrypt(payload, F.lit(key)))


def decrypted(payload: Column, key: bytes) -> Column:
    """The payload; null if the key is another one or the text has been tampered with."""
    return F.try_aes_decrypt(F.try_to_binary(payload, F.lit("base64")), F.lit(key)).cast("string")
