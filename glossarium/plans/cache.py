"""Intermediate tables and models kept in the configured folder."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: What a kept table's or model's folder is called: a name and a digest.
_OWN = re.compile(r"[a-z_]+-[0-9a-f]{16}")


@dataclass
class Config:
    """Folders of the engine."""

    corpus_dir: str
    train_dir: str
    test_dir: str
    save_dir: str

    def path(self, name: str, *of: object) -> str:
        """The folder of a table or model: its name and a digest of all that it was made from."""
        return f"{self.save_dir.rstrip('/')}/{name}-{hashlib.sha256('|'.join(map(str, of)).encode()).hexdigest()[:16]}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], reset: bool = False) -> DataFrame:
    """The table at path; built and written first if it is not there whole, or if reset."""
    if reset or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The names of the batches that are committed, in their order: what the files of `commits` say, each in a line."""
    fs, p = _fs(spark, f"{path}/commits")
    if not fs.exists(p):
        return []
    said = []
    for x in sorted(fs.listStatus(p), key=lambda x: x.getPath().getName()):
        if x.getLen():  # an empty one is of a process that ended while it wrote it
            stream = spark._jvm.java.util.Scanner(fs.open(x.getPath()))
            said.append(stream.nextLine())
            stream.close()
    return said


def _commit(spark: SparkSession, path: str, batch: str, number: int) -> bool:
    """Make the batch the one of this number: one small file, created only if it is not there.  False: another batch has the number."""
    fs, p = _fs(spark, f"{path}/commits/{number:08d}")
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(f"{batch}\n".encode()))
    out.close()
    return True


def _number(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, f"{path}/commits")
    return 1 + max([-1, *(int(x.getPath().getName()) for x in fs.listStatus(p))]) if fs.exists(p) else 0


def extended(spark: SparkSession, path: str, keys: DataFrame, build: Callable[[DataFrame], DataFrame], on: tuple[str, ...] = ("noun", "verb")) -> DataFrame:
    """The rows of the table at path for `keys` (columns `on`); what is missing is built, for the missing keys alone, and added.

    A batch is a folder with its keys and its rows, both written before the batch is committed; it counts from then on and not
    before, so a stop anywhere leaves the table as it was, and the next call builds the same keys again.  Keys that gave no rows
    are remembered too.  Of two processes that add at once, one commits and the other looks again at what is missing.
    """
    keys = keys.select(*on).distinct()
    part = lambda kind, names: spark.read.parquet(*(f"{path}/batches/{b}/{kind}" for b in names))
    while True:
        number, names = _number(spark, path), _batches(spark, path)
        folder = f"{path}/batches/{(batch := uuid.uuid4().hex)}"
        (keys.join(part("keys", names), list(on), "left_anti") if names else keys).write.parquet(f"{folder}/keys")
        new = part("keys", [batch])
        if names and new.isEmpty():
            remove(spark, folder)
            break
        build(new).write.parquet(f"{folder}/rows")
        if _commit(spark, path, batch, number):
            names.append(batch)
            break
        remove(spark, folder)
    return part("rows", names).join(keys, list(on), "left_semi")


def clear(spark: SparkSession, save_dir: str) -> None:
    """Remove what this package keeps in the folder; other files and folders stay."""
    fs, p = _fs(spark, save_dir)
    if fs.exists(p):
        for x in fs.listStatus(p):
            if x.isDirectory() and _OWN.fullmatch(x.getPath().getName()):
                fs.delete(x.getPath(), True)
