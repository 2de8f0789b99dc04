"""Tables that grow by commits: a numbered marker names what was written before it, and each number can be taken once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.plans.folders import cut_lineage


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _content(spark: SparkSession, path: str) -> str:
    system, at = _system(spark, path)
    for _ in range(50):
        stream = system.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text:
            return text
        time.sleep(0.1)  # its writer has just made it
    raise ValueError(f"empty commit {path}")


def commits(spark: SparkSession, table: str, after: int = 0) -> list[str]:
    """What each commit from number ``after`` on names, in order; a table that was never written has none, any other trouble is raised."""
    system, at = _system(spark, f"{table}/_log")
    if not system.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(at))
    return [_content(spark, f"{table}/_log/{n}") for n in names if n.isdigit() and int(n) >= after]


def commit(spark: SparkSession, table: str, number: int, content: str) -> bool:
    """Takes ``number`` for ``content``; whether nobody had."""
    system, at = _system(spark, f"{table}/_log/{number:012d}")
    try:
        stream = system.create(at, False)
    except Py4JJavaError as exc:
        if "AlreadyExists" in str(exc.java_exception.getClass().getName()):
            return False
        raise
    stream.write(bytearray(content, "utf-8"))
    stream.close()
    return True


def committed(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of all commits of an appended table; none if it has no commit. A commit whose rows are gone is an error."""
    runs = commits(spark, table)
    return spark.read.option("mergeSchema", "true").parquet(*[f"{table}/{r}" for r in runs]) if runs else None


def append_new(spark: SparkSession, table: str, keys: Sequence[str], build: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """Adds the rows of ``build(rows so far)`` whose keys the table lacks, each key once, whoever else is writing; returns those added.

    Rows are written first and count from their commit on. If others have committed meanwhile, the rows that they hold are left out and
    the next number is tried; what was written for nothing is never read.
    """
    number = len(commits(spark, table))
    known = committed(spark, table)
    rows = build(known).dropDuplicates(list(keys))
    if known is not None:
        rows = rows.join(known.select(*keys), list(keys), "left_anti")
    while True:
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{table}/{run}")
        added = spark.read.parquet(f"{table}/{run}")
        if added.isEmpty() or commit(spark, table, number, run):
            return added
        others = commits(spark, table, number)
        number += len(others)
        theirs = spark.read.parquet(*[f"{table}/{r}" for r in others]).select(*keys)
        rows = cut_lineage(added.join(theirs, list(keys), "left_anti"), "append")
