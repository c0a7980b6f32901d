"""Read-only SQL over one table: parsed, checked against allow-lists, limited, timed, recorded."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import content_digest

VIEW = "logs"
#: Plan nodes that a SELECT over the view may have after analysis; anything else is rejected
NODES = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "Union", "Distinct", "Window", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "View", "LogicalRelation", "LogicalRDD", "LocalRelation", "OneRowRelation", "Generate", "Expand", "Deduplicate", "Intersect", "Except", "Pivot", "LogicalQueryStage", "Tail", "LateralJoin", "ResolvedHint"}
#: Expressions that reach outside the data
DENIED = {"CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "PythonUDF", "ScalaUDF", "JavaUDF", "HiveSimpleUDF", "HiveGenericUDF", "SparkPartitionID", "Version"}


class Rejected(ValueError):
    """The statement is not a plain SELECT over the view."""


@dataclass
class QueryResult:
    sql: str
    columns: list[str]
    rows: list[tuple]
    row_count: int
    truncated: bool
    elapsed_ms: int
    executed_at_utc: str
    dataset_sha256: str
    result_sha256: str


def digest(columns: list[str], rows: list[tuple]) -> str:
    """SHA-256 of the rows as sorted JSON; floats to 9 significant digits, so that sums in another order agree."""

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v if isinstance(v, (int, str, bool, type(None))) else str(v)

    lines = sorted(json.dumps([plain(v) for v in r], ensure_ascii=False) for r in rows)
    return hashlib.sha256(json.dumps([columns, lines]).encode()).hexdigest()


def _children(plan) -> list:
    """Child plans and the plans of subqueries in expressions."""
    out = []
    for found in (plan.children(), plan.subqueries()):
        out += [found.apply(i) for i in range(found.size())]
    return out


def _leaves(plan) -> tuple[set[str], set[str]]:
    """(plan nodes, relations) of an analysed plan down to its views: what lies below a view is the table's own matter.

    A relation is the name of a temporary view, or the class of any other leaf.
    """
    nodes, sources, todo = set(), set(), [plan]
    while todo:
        at = todo.pop()
        kind = at.getClass().getSimpleName()
        nodes.add(kind)
        if kind == "View":
            name = at.desc().identifier()
            sources.add(name.table() if at.isTempView() and name.database().isEmpty() else f"view {name.table()}")
            continue
        below = _children(at)
        if not below and kind not in ("OneRowRelation", "CTERelationRef"):
            sources.add(kind)
        todo += below
    return nodes, sources


def _expressions(plan) -> set[str]:
    """Classes of everything in an analysed plan, of the view's table as well."""
    found = set()

    def walk(x) -> None:
        if isinstance(x, dict):
            if "class" in x and "." in str(x["class"]):
                found.add(str(x["class"]).rsplit(".", 1)[-1].rstrip("$"))
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(json.loads(plan.toJSON()))
    return found


@dataclass
class QueryEngine:
    """Runs SELECTs over ``table`` as the view ``logs`` in a session of its own.

    With a ``zone``, the view also has ``timestamp_local``. ``dataset_sha256`` names the data: the manifest's where there is one, else the digest of the table's rows.
    """

    table: DataFrame
    dataset_sha256: str = ""
    copy: str = "real"
    zone: str | None = None
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        if self.zone and "timestamp_utc" in self.table.columns:
            self.dataset_sha256 = self.dataset_sha256 or content_digest(self.table)
            self.table = self.table.withColumn("timestamp_local", F.from_utc_timestamp("timestamp_utc", self.zone))
        self.spark = self.table.sparkSession.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        jdf = self.table._jdf
        view = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, jdf.queryExecution().logical()), self.spark)
        view.createOrReplaceTempView(VIEW)
        self.dataset_sha256 = self.dataset_sha256 or content_digest(self.table)

    @property
    def copy_id(self) -> str:
        return f"{self.copy}:{self.dataset_sha256[:12]}"

    def validate(self, sql: str) -> str:
        """The statement without trailing semicolons; commands are rejected before Spark could run them."""
        text = re.sub(r"(\s*;)+\s*$", "", sql.strip())
        if re.fullmatch(rf"(?i)describe\s+{VIEW}", text):
            return text
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:
            raise Rejected(f"not one statement: {str(e).splitlines()[0][:200]}") from None
        name = plan.getClass().getSimpleName()
        if name not in NODES | {"UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases"}:
            raise Rejected(f"only SELECT is allowed, not {name}")
        analysed = self.spark.sql(text)._jdf.queryExecution().analyzed()
        nodes, sources = _leaves(analysed)
        if bad := _expressions(analysed) & DENIED:
            raise Rejected(f"not allowed: {', '.join(sorted(bad))}")
        if bad := nodes - NODES:
            raise Rejected(f"not allowed: {', '.join(sorted(bad))}")
        if bad := sources - {VIEW, "LocalRelation"}:
            raise Rejected(f"only {VIEW} can be read, not {', '.join(sorted(bad))}")
        if VIEW not in sources:
            raise Rejected(f"the statement does not read {VIEW}")
        return text

    def query(self, sql: str, limit: int = 1000, timeout_s: float = 60) -> QueryResult:
        """Run a SELECT with a row limit and a time limit; every outcome goes to the history."""
        began, at = time.time(), datetime.now(UTC).isoformat()
        entry = {"sql": sql, "at": at, "copy": self.copy_id, "limit": limit}
        try:
            text = self.validate(sql)
        except Exception as e:
            self.history.append(entry | {"status": "rejected", "error": str(e)[:300]})
            raise
        tag, fired = f"q-{uuid.uuid4().hex}", threading.Event()

        def stop():
            fired.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(timeout_s, stop)
        self.spark.addTag(tag)
        timer.start()
        try:
            if text.lower().startswith("describe"):
                columns, rows = ["name", "type"], [tuple(x) for x in self.table.dtypes]
            else:
                df = self.spark.sql(text)
                df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if k.startswith("timestamp") else F.col(f"`{c}`") for c, k in df.dtypes])
                columns, rows = df.columns, [tuple(r) for r in df.limit(limit + 1).collect()]
        except Exception as e:
            self.history.append(entry | {"status": "timeout" if fired.is_set() else "error", "error": str(e)[:300]})
            if fired.is_set():
                raise TimeoutError(f"stopped after {timeout_s} s") from None
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
        got = QueryResult(sql, columns, rows[:limit], min(len(rows), limit), len(rows) > limit, int(1000 * (time.time() - began)), at, self.dataset_sha256, digest(columns, rows[:limit]))
        self.history.append(entry | {"status": "ok", "rows": got.row_count, "ms": got.elapsed_ms, "dataset": self.dataset_sha256, "result_sha256": got.result_sha256})
        return got


def sandbox(table: DataFrame) -> QueryEngine:
    """An empty twin with the same schema: statements are analysed and run without data."""
    return QueryEngine(table.sparkSession.createDataFrame([], table.schema), "0" * 64)
