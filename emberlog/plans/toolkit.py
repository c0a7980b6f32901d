"""Tools for an analyst or an agent: bounded, read-only, with every cell sanitised."""

from __future__ import annotations

from ..operators import detectors, documents, summaries
from .safe_sql import QueryEngine, QueryResult, Rejected, sandbox

ROWS, CELL, TOTAL = 50, 120, 8000
#: Reasons for which a proposed query or mapping is discarded
CODES = {"policy_rejected", "sql_error", "timeout", "no_logs_reference", "unknown_canonical", "unknown_field", "already_mapped", "not_in_profile_mapping", "not_mapped_yet", "duplicate_id", "over_limit"}


def shown(result: QueryResult) -> str:
    """A result as text of bounded size, one line for each row."""
    out, size = ["\t".join(result.columns)], 0
    for row in result.rows[:ROWS]:
        line = "\t".join(str(v)[:CELL].replace("<", "&lt;").replace(">", "&gt;") for v in row)
        size += len(line)
        if size > TOTAL:
            out.append("...")
            break
        out.append(line)
    return "\n".join(out)


class Toolkit:
    def __init__(self, engine: QueryEngine, schema: str = "web", time_col: str = "timestamp_utc"):
        self.engine, self.schema, self.time_col = engine, schema, time_col

    def describe_dataset(self) -> dict:
        return {"columns": self.engine.table.dtypes, "copy": self.engine.copy_id}

    def run_query(self, sql: str) -> dict:
        """Run a SELECT; one with a LIMIT runs twice, to tell whether its rows are the same each time."""
        got = self.engine.query(sql, ROWS)
        same = None
        if " limit " in f" {sql.lower()} ":
            same = self.engine.query(sql, ROWS).result_sha256 == got.result_sha256
        return {"text": shown(got), "truncated": got.truncated, "reproducible": same, "sha256": got.result_sha256}

    def profile(self, column: str) -> list[dict]:
        return [r.asDict() for r in summaries.top(self.engine.table, column, 10).collect()]

    def run_detectors(self, **options) -> dict:
        found = detectors.run_all(self.engine.table, self.schema, **options)
        return {k: v if isinstance(v, str) else [r.asDict() for r in v.limit(ROWS).collect()] for k, v in found.items()}

    def build_timeline(self, bucket: str = "hour") -> list[dict]:
        return [r.asDict() for r in summaries.peaks(self.engine.table, self.time_col, bucket).collect()]

    def suspicious_text(self, column: str) -> int:
        return documents.injection_scan(self.engine.table, column).count()


def review(proposals: list[dict], table, known: set[str], most: int = 20, proposed: dict[str, str] | None = None, mapped: set[str] | None = None) -> tuple[list[dict], list[tuple[str, str]]]:
    """(accepted, discarded with a code) of proposed queries and field mappings, tried on an empty twin of the table.

    ``proposed``: canonical column -> field of the profile's mapping; a proposal that says ``confirm`` must be in it.
    ``mapped``: columns that are mapped already; a query that says what it ``needs`` waits for them.
    """
    engine, ok, out, ids = sandbox(table), [], [], set()
    done = set(mapped or ())
    for p in proposals:
        code = _refusal(p, engine, table, known, proposed, done, mapped)
        code = "duplicate_id" if p["id"] in ids else "over_limit" if len(ok) >= most else code
        ids.add(p["id"])
        if code:
            assert code in CODES
            out.append((p["id"], code))
            continue
        if "sql" not in p:
            done.add(p["canonical"])
        ok.append(p)
    return ok, out


def _refusal(p: dict, engine: QueryEngine, table, known: set[str], proposed: dict[str, str] | None, done: set[str], mapped: set[str] | None) -> str | None:
    if "sql" in p:
        if mapped is not None and set(p.get("needs", ())) - done:
            return "not_mapped_yet"
        try:
            engine.query(p["sql"])
        except Rejected as e:
            return "no_logs_reference" if "does not read" in str(e) else "policy_rejected"
        except TimeoutError:
            return "timeout"
        except Exception:  # noqa: BLE001  whatever Spark says, the statement does not run
            return "sql_error"
        return None
    if p.get("canonical") not in known:
        return "unknown_canonical"
    if p.get("field") not in table.columns:
        return "unknown_field"
    if p["canonical"] in done:
        return "already_mapped"
    if p.get("confirm") and (proposed or {}).get(p["canonical"]) != p["field"]:
        return "not_in_profile_mapping"
    return None
