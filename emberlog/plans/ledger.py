"""Evidence ledger: an append-only chain of SHA-256 hashes in a JSONL file, with replay of its queries."""

from __future__ import annotations

import fcntl
import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64
TYPES = {"case_opened", "query", "finding", "detector_run", "roles", "case_candidate", "note", "hypothesis", "hypothesis_update", "data_copy", "replay", "tool_call", "agent_turn", "correlation", "data_profile", "timezone_confirmation", "report_export", "incident_assessment"}


def entry_hash(seq: int, ts: str, kind: str, data: dict, prev: str) -> str:
    return hashlib.sha256(json.dumps([seq, ts, kind, data, prev], sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


class Ledger:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.touch(exist_ok=True)

    def entries(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text(encoding="utf-8").splitlines() if x]

    def append(self, kind: str, data: dict) -> dict:
        """Append under a file lock, after reading the chain's end anew, so that writers cannot fork it."""
        if kind not in TYPES:
            raise ValueError(f"unknown entry type {kind}")
        data = json.loads(json.dumps(data, default=str))
        with self.path.open("r+", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            last = None
            for line in f:
                last = line or last
            prev = json.loads(last) if last else {"seq": 0, "hash": GENESIS}
            ts = datetime.now(UTC).isoformat()
            e = {"seq": prev["seq"] + 1, "ts_utc": ts, "type": kind, "data": data, "prev_hash": prev["hash"]}
            e["hash"] = entry_hash(e["seq"], ts, kind, data, prev["hash"])
            f.seek(0, 2)
            f.write(json.dumps(e, ensure_ascii=False) + "\n")
        return e

    def verify(self) -> list[str]:
        """What is wrong with the chain; nothing if it holds."""
        out, prev = [], {"seq": 0, "hash": GENESIS}
        for e in self.entries():
            if e["seq"] != prev["seq"] + 1:
                out.append(f"entry {e['seq']} follows {prev['seq']}")
            if e["prev_hash"] != prev["hash"]:
                out.append(f"entry {e['seq']} does not continue the chain")
            if e["hash"] != entry_hash(e["seq"], e["ts_utc"], e["type"], e["data"], e["prev_hash"]):
                out.append(f"entry {e['seq']} was changed")
            prev = e
        return out

    def finding_id(self, detector: str, entity: dict, copy_id: str) -> str:
        return hashlib.sha256(json.dumps([detector, entity, copy_id], sort_keys=True, default=str).encode()).hexdigest()[:16]

    def add_finding(self, detector: str, entity: dict, metrics: dict, severity: str, copy_id: str) -> dict | None:
        """Append a finding once; the copy of the data is part of its identity."""
        fid = self.finding_id(detector, entity, copy_id)
        if any(e["type"] == "finding" and e["data"]["id"] == fid for e in self.entries()):
            return None
        return self.append("finding", {"id": fid, "detector": detector, "entity": entity, "metrics": metrics, "severity": severity, "copy": copy_id})

    def replay(self, engines: dict) -> list[tuple[int, str]]:
        """Run every recorded query again on its own copy: match, mismatch, nondeterministic, schema_drift or skipped."""
        out = []
        for e in self.entries():
            if e["type"] != "query" or e["data"].get("status") != "ok":
                continue
            engine = engines.get(e["data"]["copy"])
            if engine is None:
                out.append((e["seq"], "skipped"))
                continue
            try:
                one = engine.query(e["data"]["sql"], e["data"].get("limit", 1000))
            except Exception:  # noqa: BLE001  a statement that no longer runs is a finding of the replay
                out.append((e["seq"], "schema_drift"))
                continue
            if one.result_sha256 == e["data"]["result_sha256"]:
                out.append((e["seq"], "match"))
            else:
                two = engine.query(e["data"]["sql"], e["data"].get("limit", 1000))
                out.append((e["seq"], "mismatch" if two.result_sha256 == one.result_sha256 else "nondeterministic"))
        self.append("replay", {"results": out})
        return out


def chain_breaks(entries: DataFrame) -> DataFrame:
    """For ledgers of many cases as a table (case, seq, hash, prev_hash): entries that do not continue their chain."""
    before = entries.select("case", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("want"))
    joined = entries.join(before, ["case", "seq"], "left")
    return joined.filter(F.coalesce("want", F.lit(GENESIS)) != F.col("prev_hash")).select("case", "seq")
