"""Scans, reports, page headers and blob ids against plain Python."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from marginalia.operators import audits
from marginalia.plans.audits import HEADERS
from marginalia.sources.fixtures import values


def test_scan_without_manifest(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, text in [("a.json", "x" * 2048), ("deep/b.json", "\U00020000" * 1025), ("c.txt", "y")]:
        (tmp_path / name).write_text(json.dumps({"id": name, "text": text}))
    rows = audits.scanned(spark, str(tmp_path), "id string, text string")
    assert sorted((r["id"], r["file"].rsplit("/", 1)[1]) for r in rows.collect()) == [("a.json", "a.json"), ("deep/b.json", "b.json")]
    assert [r["id"] for r in audits.within_units(rows, "text").collect()] == ["a.json"]


def test_report_is_written_when_it_changes(spark, tmp_path):
    path, rows = str(tmp_path / "report"), values(spark, "a int", [(1,), (1,), (2,)])
    assert not audits.report(rows, path) and not (tmp_path / "report").exists()
    assert not audits.report(rows, path, write=True)
    assert audits.report(rows, path)
    assert not audits.report(values(spark, "a int", [(1,), (2,), (2,)]), path)
    assert audits.report(rows, path, write=True)


def fields(text):
    """One letter after another with a stack."""
    m = re.search(r"\{\{\s*[A-Za-z0-9_. ]*header[A-Za-z0-9_. ]*\s*(\||\}\})", text or "", re.I)
    if not m:
        return {}
    out, part, depth, i, parts = {}, "", 0, m.start() + 2, []
    while i < len(text):
        two = text[i : i + 2]
        if two == "}}" and depth == 0:
            for p in parts[0:] + [part]:
                key, eq, value = p.partition("=")
                if eq and key.strip():
                    out[key.strip().lower()] = value.strip()
            return out
        if two in ("{{", "[[", "}}", "]]"):
            depth += 1 if two in ("{{", "[[") else -1
            part, i = part + two, i + 2
        elif text[i] == "|" and depth == 0:
            parts, part, i = [*parts, part], "", i + 1
        else:
            part, i = part + text[i], i + 1
    return {}


def test_header_fields(spark):
    choose = random.Random(7)

    def value(depth):
        inner = "".join(choose.choice(["甲", " x ", "a=b", "{w}", "[l]"]) for _ in range(choose.randint(0, 3)))
        if depth and "{w}" in inner:
            inner = inner.replace("{w}", "{{w|" + value(depth - 1) + "|" + value(depth - 1) + "}}")
        return inner.replace("{w}", "w").replace("[l]", "[[甲|乙]]")

    made = [(f"m{k}", "前{{n}}" * (k % 2) + "{{header|" + "|".join(f"{choose.choice(['a', 'B', 'next', ''])}={value(3)}" for _ in range(choose.randint(0, 4))) + "}}後{{z|q=r}}") for k in range(60)]
    rows = HEADERS + made
    got = values(spark, "id string, text string", rows).select("id", audits.header_fields(F.col("text")).alias("f")).collect()
    assert {r["id"]: {x["key"]: x["value"] for x in r["f"]} for r in got} == {i: fields(t) for i, t in rows}


def test_blob_id(spark):
    texts = ["", "甲\n", "a" * 1000, None]
    want = [None if t is None else hashlib.sha1(b"blob %d\0" % len(t.encode()) + t.encode()).hexdigest() for t in texts]
    assert [r[0] for r in values(spark, "k int, text string", list(enumerate(texts))).orderBy("k").select(audits.blob_id(F.col("text"))).collect()] == want


def test_empty_tables(spark):
    none = values(spark, "id long, text string", [])
    assert {r["check"]: r["ok"] for r in audits.cohort_checks(none, none, "id", "text", 0).collect()} == {"unique ids": True, "unique texts": True, "fresh texts": True, "declared count": True}
    assert audits.open_questions(none, none, ["id"], "text").count() == 0
    assert audits.projected(none, "text", "id", 3)[0].count() == 0


def test_content_audit_shuffles_no_text(spark):
    from collections import Counter, namedtuple

    Row = namedtuple("Row", "work text")
    works = spark.createDataFrame([Row("a", "x y"), Row("a", None), Row("b", "z"), Row(None, "x")])
    fixtures = spark.createDataFrame([("a", "x", True), ("a", "z", False), ("b", "x", True), ("c", "x", False), (None, "x", False), ("a", "x", True)], "work string, needle string, wanted boolean")
    found = audits.content_audit(works, fixtures, "work", "text")
    assert Counter(map(tuple, found.collect())) == Counter([("a", "x", True, True, True), ("a", "z", False, False, True), ("b", "x", True, False, False), ("c", "x", False, False, True), (None, "x", False, False, True)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\(work#\d+, \d", plan)
