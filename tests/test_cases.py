"""Custody checks of a case, each failing alone; findings on a common clock; drafts with derived columns."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from test_core import WEB, web_rows, write_csv

from emberlog.plans import incident, questions
from emberlog.plans.triage import Case
from emberlog.sources import ingest, store


@pytest.fixture
def case(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", web_rows())
    c = Case(spark, str(tmp_path / "case"))
    facts = ingest.ingest(spark, path, WEB, f"{c.folder}/canonical", overwrite=True)
    c.mapping_file.write_text(json.dumps(WEB.__dict__, sort_keys=True, default=str, indent=1))
    facts |= {"mapping_file_sha256": hashlib.sha256(c.mapping_file.read_bytes()).hexdigest()}
    store.write_text(spark, f"{c.folder}/canonical.manifest.json", json.dumps(facts, default=str))
    c.ledger.append("case_opened", facts)
    return c, tmp_path


def failing(c):
    return sorted(k for k, v in c.verify().items() if v is not True)


def test_each_check_fails_alone(spark, case):
    c, at = case
    assert failing(c) == []
    raw = at / "a.csv"
    was = raw.read_bytes()
    raw.write_bytes(was.replace(b"1", b"2", 1))
    assert failing(c) == ["input"] and [r["start"] for r in c.changed_chunks("input").collect()] == [0]
    raw.write_bytes(was)
    mapping = c.mapping_file.read_text()
    c.mapping_file.write_text(mapping + " ")
    assert failing(c) == ["mapping", "mapping_in_ledger"]
    c.mapping_file.write_text(mapping)
    part = next(p for p in (at / "case" / "canonical").iterdir() if p.name.startswith("part-"))
    bytes_ = part.read_bytes()
    changed = bytearray(bytes_)
    changed[len(changed) // 2] ^= 1
    part.write_bytes(changed)
    assert failing(c) == ["table", "table_in_ledger"] and [r["name"] for r in c.changed_chunks().collect()] == [part.name]
    part.write_bytes(bytes_)
    told = c.manifest
    write = lambda facts: store.write_text(spark, f"{c.folder}/canonical.manifest.json", json.dumps(facts))
    write(told | {"mapping_file_sha256": "0"})
    assert failing(c) == ["mapping"]
    write(told | {"custody": told["custody"] | {"output": told["custody"]["output"] | {"root": "0"}}})
    assert failing(c) == ["table"]
    write(told)
    entry = c.ledger.path.read_text()
    c.ledger.path.write_text(entry.replace('"rows": 40', '"rows": 41'))
    assert failing(c) == ["chain"]
    c.ledger.path.write_text(entry)
    assert failing(c) == []


def test_losses_are_reported_and_do_not_raise(spark, case):
    c, at = case
    (at / "case" / "canonical").rename(at / "gone")
    assert failing(c) == ["table", "table_in_ledger"]
    (at / "a.csv").rename(at / "b.csv")
    assert failing(c) == ["input", "table", "table_in_ledger"]
    (at / "case" / "canonical.manifest.json").rename(at / "m.json")
    assert c.verify()["table"] is False and c.verify()["input"] is None


def test_findings_of_two_clocks_in_true_order(spark):
    base = 1_700_000_000_000
    rows = lambda host, ms: [(i, host, f"d{i % 2}", base + m) for i, m in enumerate(ms)]
    make = lambda r: spark.createDataFrame(r, "source_row long, host string, dst_ip string, ms long").withColumn("timestamp_utc", F.timestamp_millis("ms"))
    endpoint, firewall = make(rows("pc", [12_500, 32_500])), make(rows("pc", [11_000, 31_000]))
    found = spark.createDataFrame([("1", "d", "high", ["host"], ["pc"]), ("2", "e", "low", ["host", "dst_ip"], ["pc", "d1"]), ("3", "none", "low", ["host"], ["other"]), ("4", "gone", "low", ["no_such"], ["x"])], "id string, detector string, severity string, columns array<string>, values array<string>")
    got = incident.findings_timeline({"edr": (endpoint, found), "fw": (firewall, found)}, {"edr": 2500}).collect()
    said = [(r["case"], r["kind"], r["detector"], r["events"]) for r in got]
    assert said == [("edr", "begins", "d", 2), ("fw", "begins", "d", 2), ("edr", "begins", "e", 1), ("edr", "ends", "d", 2), ("fw", "begins", "e", 1), ("fw", "ends", "d", 2)]
    assert {r["case"]: r["corrected"] for r in got} == {"edr": True, "fw": False} and got[2]["row"] == 1


def test_questions_about_values(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.0.0.9", "/a", 1), ("10.0.0.9", "10.0.0.1", "/b", 2), ("10.0.0.1", "10.0.0.9", None, 3)], "src_ip string, dst_ip string, endpoint string, source_row long").withColumn("timestamp_utc", F.timestamp_seconds(F.col("source_row") + 1_700_000_000))
    kind, got = questions.answer("when was '10.0.0.9' first seen?", df)
    assert kind == "value_seen" and {(r["column"], r["n"], r["row"]) for r in got.collect()} == {("src_ip", 1, 2), ("dst_ip", 2, 1)}
    kind, got = questions.answer("¿quién habla con quién?", df)
    assert kind == "relations" and got.first()["a"] == "10.0.0.1" and got.first()["n"] == 2
    kind, got = questions.answer("which columns are there", df)
    assert kind == "columns" and {r["name"]: (r["filled"], r["distinct"]) for r in got.collect()}["endpoint"] == (2, 2)


def test_draft_has_derived_columns_and_gaps(spark, tmp_path):
    rng = random.Random(2)
    lines = ["ts,ip,uri,status"]
    for i in range(400):
        lines.append(f"2024-05-{1 + i % 28:02d} 10:00:{i % 60:02d},10.0.0.{i % 9},/a?invoice={rng.randrange(10**6) if i % 50 else ''}&site=s{i % 3},200")
    path = tmp_path / "x.csv"
    path.write_text("\n".join(lines) + "\n")
    c = Case(spark, str(tmp_path / "case"))
    got = c.draft(str(path))
    names = {p["name"]: p for p in got["derived"]}
    assert any("invoice" in n for n in names) and any("site" in n for n in names)
    invoice = next(p for n, p in names.items() if "invoice" in n)
    assert invoice["present"] == 400 and invoice["gap"] == invoice["present"] - invoice["hits"] == 8
    assert got["status"] == "needs_review" and any("give no value" in x for x in got["open"])
    assert len((tmp_path / "case" / "raw_profile.json").read_bytes()) <= 24_000
