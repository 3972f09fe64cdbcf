"""Queries over the sample corpus; what they must return is written down as literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sample
from . import evidence, ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}

CLAIMS = [
    (1, "calls", "main", "start", "supported"), (2, "calls", "main", "init", "unknown"), (3, "calls", "helper", "grow", "contradicted"), (4, "calls", "start", "trace", "conditional"),
    (5, "reaches", "main", "alloc", "supported"), (6, "reaches", "main", "malloc", "conditional"), (7, "reaches", "alloc", "main", "unknown"), (8, "includes", "main.c", "engine.h", "supported"),
    (9, "includes", "main.c", "pool.hpp", "contradicted"), (10, "definition_exists", "grow", "", "supported"), (11, "definition_exists", "nowhere", "", "unknown"), (12, "build_active", "start", "", "supported"),
    (13, "riddle", "main", "x", "unknown"),
]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _facts(spark):
    return ingest.facts(sample.files(spark), ingest.macro_map(sample.MACROS))


def _rows(rows, columns):
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) t({columns})".replace("None", "NULL")


@query(_rows([
    ("src/engine.c", "start", "init_fast", "inactive"), ("src/engine.c", "start", "init_slow", "active"), ("src/engine.c", "start", "init", "inactive"), ("src/engine.c", "start", "trace", "conditional"),
    ("src/engine.c", "init", "alloc", "active"), ("src/engine.c", "helper", "alloc", "active"), ("src/main.c", "main", "start", "active"), ("src/main.c", "main", "helper", "active"), ("src/main.c", "main", "printf", "active"),
    ("src/pool.cpp", "pool::alloc", "grow", "active"), ("src/pool.cpp", "pool::grow", "old_grow", "inactive"), ("src/pool.cpp", "pool::grow", "malloc", "active"),
], "path, caller, callee, build_status"))
def corpus_calls(spark, sf_dir):
    return _facts(spark).filter("fact_type = 'call'").select("path", F.col("subject").alias("caller"), F.col("object").alias("callee"), "build_status")


@query(_rows([
    ("include/engine.h", 4, "start", "declaration", "conditional"), ("include/engine.h", 5, "helper", "declaration", "conditional"), ("src/engine.c", 4, "start", "definition", "active"), ("src/engine.c", 17, "init", "definition", "active"),
    ("src/engine.c", 22, "helper", "definition", "active"), ("src/main.c", 4, "helper", "declaration", "active"), ("src/main.c", 6, "main", "definition", "active"), ("src/pool.cpp", 4, "pool::alloc", "definition", "active"),
    ("src/pool.cpp", 7, "pool::grow", "definition", "active"), ("third_party/pool/pool.hpp", 3, "pool::alloc", "declaration", "active"),
], "path, line, name, kind, build_status").replace("SELECT *", "SELECT path, CAST(line AS BIGINT) AS line, name, kind, build_status"))
def corpus_symbols(spark, sf_dir):
    return _facts(spark).filter("fact_type = 'symbol'").select("path", "line", F.col("subject").alias("name"), F.col("predicate").alias("kind"), "build_status")


@query(_rows([
    ("include/engine.h", "ifndef ENGINE_H", "2-5", "conditional", "macro_unknown"), ("src/engine.c", "if defined(FAST) && LEVEL > 2", "6-6", "inactive", "evaluated"), ("src/engine.c", "elif LEVEL == 1", "8-8", "active", "evaluated"),
    ("src/engine.c", "else", "10-10", "inactive", "preceded_by_active_branch"), ("src/engine.c", "ifdef TRACE", "13-13", "conditional", "macro_unknown"), ("src/pool.cpp", "if 0", "9-9", "inactive", "evaluated"),
], "path, guard, content, status, reason"))
def corpus_guards(spark, sf_dir):
    return _facts(spark).filter("fact_type = 'build_guard'").select("path", F.trim("subject").alias("guard"), F.col("object").alias("content"), F.col("build_status").alias("status"), F.col("detail").alias("reason"))


@query(_rows(CLAIMS, "claim_id, claim_type, subject, object, verdict"))
def corpus_claims(spark, sf_dir):
    claims = spark.createDataFrame([c[:4] for c in CLAIMS], "claim_id int, claim_type string, subject string, object string")
    return evidence.verify(claims, _facts(spark))


@query(_rows([(1, "supported", 2, "safe"), (2, "contradicted", 2, "unsafe"), (3, "unknown", 0, "needs_more_evidence")], "text_id, overall, claims, safety").replace("SELECT *", "SELECT text_id, overall, CAST(claims AS BIGINT) AS claims, safety"))
def corpus_answers(spark, sf_dir):
    texts = spark.createDataFrame([(1, "main calls start and helper."), (2, "main calls start. main.c includes pool.hpp"), (3, "Nothing is claimed.")], "text_id int, body string")
    return evidence.verify_text(texts, "text_id", "body", _facts(spark))


@query(_rows([
    ("start", "calls init_fast", "active", "conditional", True), ("start", "calls init_slow", "inactive", "conditional", True), ("start", "calls init", "inactive", "conditional", True), ("start", "calls trace", "conditional", "active", True),
], "subject, what, fast, trace, changed"))
def corpus_profiles(spark, sf_dir):
    return evidence.profile_matrix(sample.files(spark), {"fast": {"FAST": "1", "LEVEL": "3"}, "trace": {"TRACE": ""}}).filter("changed")


@query(_rows([("src/main.c", "main", "start")], "path, caller, callee"))
def corpus_question(spark, sf_dir):
    found = evidence.collect(_facts(spark), "Who calls `start`?")
    return found.select("path", F.col("subject").alias("caller"), F.col("object").alias("callee"))
