"""Derived tables kept between queries: written once to the shared folder and read again, so later plans start from a scan.

A table is known by its name, its source, what the source holds (every file below it) and how it is made. Older versions go when a
new one is written, and beyond MOST tables the one that was read longest ago.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable
from types import CodeType, FunctionType

from pyspark.sql import DataFrame, SparkSession

#: Tables of one application that are kept at most.
MOST = 200
_paths: OrderedDict[tuple, str] = OrderedDict()
_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a purely local session without it."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="crosspanel-cache-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def _store(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stamp(spark: SparkSession, source: str) -> str:
    """A digest of paths, sizes and times of all files below a folder, however deep, by Spark's own file systems; empty without such a folder."""
    path, fs = _store(spark, source)
    if not fs.exists(path):
        return ""
    found, seen = fs.listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def fingerprint(made_by: object) -> str:
    """A digest of how a table is made: the code of its function and of those that it holds, their constants and the values they
    are given; of frames the analysed plan, without the numbers that Spark gives anew each time. Nothing is built or run."""
    parts: list[str] = []
    todo, seen = [made_by], set()
    while todo:
        x = todo.pop()
        if isinstance(x, DataFrame):
            parts.append(re.sub(r"#\d+L?|@[0-9a-f]+|plan_id=\d+", "", x._jdf.queryExecution().analyzed().toString()))
        elif isinstance(x, FunctionType):
            if id(x) not in seen:
                seen.add(id(x))
                todo += [x.__code__, *(c.cell_contents for c in x.__closure__ or ()), *(x.__defaults__ or ()), *(x.__kwdefaults__ or {}).values()]
        elif isinstance(x, CodeType):
            parts.append(x.co_code.hex() + repr(x.co_names))
            todo += x.co_consts
        elif not isinstance(x, SparkSession):
            parts.append(repr(x) if isinstance(x, str | int | float | bytes | tuple | list | dict | None) else type(x).__name__)
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def kept(name: str, spark: SparkSession, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of ``source``: made at its first use in an application, and again when files of the source or the way it is made change.

    Older versions of the table, and tables over the limit, are deleted: a frame that was made from one and not run yet must be made again.
    """
    whose = (spark.sparkContext.applicationId, name, source)
    key = (*whose, stamp(spark, source), fingerprint(make))
    if key not in _paths:
        path = f"{folder(spark)}/kept-{re.sub(r'[^A-Za-z0-9]+', '-', name)}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        for old in [k for k in _paths if k[:3] == whose]:
            _drop(spark, old)
        _paths[key] = path
        while sum(k[0] == whose[0] for k in _paths) > MOST:
            _drop(spark, next(k for k in _paths if k[0] == whose[0]))
    _paths.move_to_end(key)
    return spark.read.parquet(_paths[key])


def _drop(spark: SparkSession, key: tuple) -> None:
    path, fs = _store(spark, _paths.pop(key))
    fs.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all kept tables of this application."""
    for key in [k for k in _paths if k[0] == spark.sparkContext.applicationId]:
        _drop(spark, key)
