"""The triage of a log file as resumable stages, and a report over its results."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import content_digest
from ..operators import detectors, privacy, profile
from ..sources import custody, ingest, raw_profile, store
from ..sources.readers import open_source
from .ledger import Ledger
from .safe_sql import QueryEngine

#: Rows of a profile's block, and findings of a detector, that go to the ledger; it says where there are more, and the
#: profile's blocks are tables of the case in full.
MOST = 100
STAGES = ["draft", "ingest", "copy", "profile", "detectors", "correlate"]


class Case:
    """The canonical table of a file, its pseudonymised copy and their manifests in a folder of any store.

    The ledger and the state of the stages are small files that are locked and appended, so they stay on the analyst's
    machine: in ``local``, or in the folder itself where that is a local path.
    """

    def __init__(self, spark: SparkSession, folder: str, local: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        if local is None and "://" in folder:
            raise ValueError("a case in a remote store needs a local folder for its ledger")
        home = Path(local or folder)
        home.mkdir(parents=True, exist_ok=True)
        self.ledger = Ledger(home / "ledger.jsonl")
        self.state_file, self.mapping_file = home / "state.json", home / "mapping.json"

    @property
    def state(self) -> dict:
        return json.loads(self.state_file.read_text()) if self.state_file.exists() else {}

    def done(self, stage: str, facts: dict) -> None:
        self.state_file.write_text(json.dumps(self.state | {stage: facts}, default=str, indent=1))

    @property
    def manifest(self) -> dict:
        return json.loads(store.read_text(self.spark, f"{self.folder}/canonical.manifest.json"))

    def table(self, copy: str = "real") -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{'canonical' if copy == 'real' else 'pseudonymized'}")

    def engine(self, copy: str = "real") -> QueryEngine:
        made = self.manifest
        zone = made["timezone"]["name"] if made["timezone"]["provenance"] == "declared" else None
        return QueryEngine(self.table(copy), made["data_sha256"] if copy == "real" else "", copy, zone)

    def dictionary(self) -> privacy.Dictionary:
        """Values and aliases of the copy, for texts that come from or go to the analyst."""
        names = self.state["copy"]["aliases"]
        return privacy.Dictionary({n: self.spark.read.parquet(f"{self.folder}/aliases/{n}") for n in names})

    #: What ``verify`` looks at: bytes of table, mapping and input against the manifest, the ledger's chain, and bytes of
    #: table and mapping against the ledger's first entry.
    CHECKS = ("table", "mapping", "input", "chain", "table_in_ledger", "mapping_in_ledger")

    def verify(self) -> dict[str, bool | None]:
        """Custody checks by file bytes; False also where something is gone, None where nothing is recorded to check against."""
        out: dict[str, bool | None] = dict.fromkeys(self.CHECKS)
        entries = self.ledger.entries()
        out["chain"] = not self.ledger.verify()
        first = next((e["data"] for e in entries if e["type"] == "case_opened"), None)
        made = self.manifest if store.exists(self.spark, f"{self.folder}/canonical.manifest.json") else None
        mapping = hashlib.sha256(self.mapping_file.read_bytes()).hexdigest() if self.mapping_file.exists() else None
        seal = (made or first or {}).get("custody")
        now = None
        if seal:
            now = custody.current(self.spark, f"{self.folder}/canonical", seal["output"])
        if made is None:
            out["table"] = out["mapping"] = False
        else:
            out["table"] = now is not None and now == made["custody"]["output"]["root"]
            out["mapping"] = mapping is not None and mapping == made.get("mapping_file_sha256")
            out["input"] = custody.holds(self.spark, made["input"]["path"], made["custody"]["input"])
        if first:
            out["table_in_ledger"] = now is not None and now == first["custody"]["output"]["root"]
            out["mapping_in_ledger"] = mapping is not None and mapping == first.get("mapping_file_sha256")
        return out

    def changed_chunks(self, what: str = "output") -> DataFrame:
        """(name, start, was, now): chunks of the table, or of the input, that are not what was sealed."""
        made = self.manifest
        return custody.changes(self.spark, f"{self.folder}/canonical" if what == "output" else made["input"]["path"], made["custody"][what])

    def draft(self, path: str) -> dict:
        """Profile of the raw file with a proposed mapping and derived columns; decisions that are open are listed.

        What is kept, in ``raw_profile.json``, fits the size budget of a profile.
        """
        df, _ = open_source(self.spark, path)
        found = raw_profile.profile(df)
        time, fields = found["timestamp"], found["mapping"]["fields"]
        open_points = [f"{c}: {fs}" for c, fs in found["mapping"]["ambiguous"].items()]
        if time.get("other_reading"):
            open_points.append(f"day and month: {time['format']} or {time['other_reading']}")
        source = next((fields[c] for c in ("uri", "request_line", "query_string") if c in fields), None)
        derived = raw_profile.coverage(df, raw_profile.propose_derived(df, source, taken=set(fields))) if source else []
        gaps = [f"{p['name']}: {p['gap']} of {p['present']} rows with {p['key']} give no value" for p in derived if p["gap"]]
        out = found | {"derived": derived, "status": "ready" if time and not open_points and not gaps else "needs_review", "open": open_points + gaps}
        store.write_text(self.spark, f"{self.folder}/raw_profile.json", json.dumps(raw_profile.trimmed(out), default=str, sort_keys=True))
        return out

    def run(self, path: str, mapping: ingest.Mapping, options: dict | None = None) -> dict:
        """Run the stages that are not done yet; each one's outcome is kept and goes to the ledger."""
        options = options or {}
        if "draft" not in self.state:
            self.done("draft", {"status": self.draft(path)["status"]})
        if "ingest" not in self.state:
            facts = ingest.ingest(self.spark, path, mapping, f"{self.folder}/canonical", overwrite=True)
            self.mapping_file.write_text(json.dumps(mapping.__dict__, sort_keys=True, default=str, indent=1))
            facts |= {"mapping_file_sha256": hashlib.sha256(self.mapping_file.read_bytes()).hexdigest()}
            store.write_text(self.spark, f"{self.folder}/canonical.manifest.json", json.dumps(facts, default=str, sort_keys=True, indent=1))
            self.ledger.append("case_opened", facts)
            self.done("ingest", facts)
        real = self.table()
        if "copy" not in self.state:
            rules = privacy.policy(real)
            copy, tables = privacy.pseudonymize(real, rules)
            copy.write.mode("overwrite").parquet(f"{self.folder}/pseudonymized")
            for name, t in tables.items():
                t.write.mode("overwrite").parquet(f"{self.folder}/aliases/{name}")
            facts = {"policy": privacy.fingerprint(rules), "aliases": sorted(tables)}
            self.done("copy", facts)
            self.ledger.append("data_copy", facts)
        if "profile" not in self.state:
            blocks = profile.data_profile(real, "timestamp_utc")
            facts = {}
            for name, block in blocks.items():
                # the whole block is a table; the profile's text shows its first rows
                block.write.mode("overwrite").parquet(f"{self.folder}/profile/{name}")
                whole = self.spark.read.schema(block.schema).parquet(f"{self.folder}/profile/{name}")
                rows = whole.orderBy(*[F.col(f"`{c}`").cast("string") for c in whole.columns]).limit(MOST + 1).collect()
                facts[name] = {"rows": [r.asDict(recursive=True) for r in rows[:MOST]], "more": len(rows) > MOST, "table": f"profile/{name}"}
            text = json.dumps(facts, sort_keys=True, default=str)
            store.write_text(self.spark, f"{self.folder}/data_profile.json", text)
            self.done("profile", {"blocks": sorted(facts)})
            self.ledger.append("data_profile", {"sha256": hashlib.sha256(text.encode()).hexdigest(), "blocks": facts})
        if "detectors" not in self.state:
            roles = detectors.resolve_roles(real, declared=mapping.roles)
            self.ledger.append("roles", roles)
            counts = {}
            for name, found in detectors.run_all(real, mapping.schema, roles, most=MOST + 1, **options).items():
                if isinstance(found, str):
                    counts[name] = found
                    continue
                try:
                    rows = found.collect()
                except Exception as e:  # noqa: BLE001  one detector must not stop the others
                    counts[name] = f"failed: {type(e).__name__}"
                    continue
                # findings come in a total order; what is left out is said
                counts[name] = len(rows) if len(rows) <= MOST else f"{MOST} and more"
                spec = detectors.REGISTRY[name]
                for r in rows[:MOST]:
                    facts = r.asDict(recursive=True)
                    entity = {c: facts[c] for c in spec.holds}
                    self.ledger.add_finding(name, entity, facts | {"mitre": list(spec.mitre)}, facts.get("severity", "info"), "real")
            self.ledger.append("detector_run", counts)
            self.done("detectors", counts)
        if "correlate" not in self.state:
            said = [e["data"] for e in self.ledger.entries() if e["type"] == "finding"]
            # a group counts for each of its members
            rows = [(str(x), e["detector"], e["severity"]) for e in said for v in [next(iter(e["entity"].values()), "")] for x in (v if isinstance(v, list) else [v])]
            found = self.spark.createDataFrame(rows, "entity string, detector string, severity string")
            top = [r.asDict() for r in detectors.correlate(found).orderBy(F.col("signals").desc(), "entity").collect()]
            self.ledger.append("correlation", {"candidates": top})
            self.done("correlate", {"candidates": len(top)})
        return self.state

    def report(self, shareable: bool = False) -> str:
        """A Markdown report of what the ledger holds; entries' texts are escaped.

        ``shareable``: entities as aliases, and refused if a real value is left in the text.
        """
        e = self.ledger.entries()
        of = lambda kind: [x["data"] for x in e if x["type"] == kind]
        opened, words = (of("case_opened") or [{}])[0], self.dictionary() if shareable else None
        flat = lambda x: str(x).replace("|", "\\|").replace("<", "&lt;").replace("\n", " ")

        def name(column: str, value) -> str:
            if isinstance(value, list):
                return ", ".join(name(column, v) for v in value)
            return flat(words.alias(column, value) if words else value)

        def entity(f: dict) -> str:
            holds = detectors.REGISTRY[f["detector"]].holds
            roles = (of("roles") or [{}])[-1]
            return ", ".join(name(roles.get(h[1:], h) if h[:1] == "@" else h, f["entity"].get(c)) for c, h in holds.items())

        out = ["# Case report", "", f"Entries: {len(e)}; chain: {'holds' if not self.ledger.verify() else 'BROKEN'}", ""]
        out += ["## Data", "", f"* rows: {opened.get('rows')}", f"* time: {' to '.join(opened.get('time_range', []))}", f"* zone: {opened.get('timezone')}", f"* table: {opened.get('data_sha256')}", f"* input: {opened.get('input', {}).get('sha256')}", f"* mapping: {opened.get('mapping_sha256')}"]
        out += ["", "## Quality", "", *([f"* {flat(w)}" for w in opened.get("warnings", [])] or ["* nothing to say"])]
        out += ["", "## Roles", "", *[f"* {k}: {v}" for r in of("roles")[-1:] for k, v in r.items()]]
        out += ["", "## Detectors", "", *[f"* {k}: {v}" for r in of("detector_run")[-1:] for k, v in sorted(r.items())]]
        out += ["", "## Findings", "", "| severity | detector | entity | techniques |", "|-|-|-|-|"]
        for f in sorted(of("finding"), key=lambda f: (-detectors.SEVERITY.get(f["severity"], 0), f["detector"], f["id"])):
            out.append(f"| {f['severity']} | {f['detector']} | {entity(f)} | {', '.join(f['metrics'].get('mitre', []))} |")
        actor = (of("roles") or [{}])[-1].get("actor", "src_ip")
        out += ["", "## Signals that agree", "", *[f"* {name(actor, c['entity'])}: {', '.join(c['detectors'])} ({c['severity']})" for r in of("correlation")[-1:] for c in r["candidates"] if c["signals"] >= 2]]
        out += ["", "## Hypotheses and notes", "", *[f"* {flat(x)}" for x in of("hypothesis") + of("note")]]
        out += ["", "## Queries", "", *[f"* `{flat(q['sql'])}` on {q['copy']}: {q.get('rows')} rows, {q.get('result_sha256', '')[:12]}" for q in of("query")]]
        out += ["", "## Replay", "", *[f"* entry {s}: {r}" for x in of("replay")[-1:] for s, r in x["results"]]]
        body = "\n".join(out) + "\n"
        if words and (left := words.real_hits(body)):
            raise ValueError(f"the report still names {sorted(left)}")
        return body + f"\nBody SHA-256: {hashlib.sha256(body.encode()).hexdigest()}\n"
