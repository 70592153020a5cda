"""Stages that know whether they are stale, and whose tables change all at once.

A stage writes its tables into a folder of its own and then a small record that names the folder, its fingerprint, and the
run's number. Readers go by the record of the highest number, so a run that dies leaves the tables before it in place, and
another run finds the stage still stale. A fingerprint covers the stage's input, settings and code; a stage whose record
has the same one isn't run again.

Defined cases: two runs of one stage at a time both end, and the later record counts; records that can't be read don't count;
a stage without records can't be read, which is an error. Folders of runs before the last but one are removed once a run
ends, so whoever reads the tables of the run before can finish.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 2


def of_rows(df: DataFrame) -> str:
    """A fingerprint of a table's rows in any order, from sums of two hashes: one pass, nothing but the sums comes back."""
    one, two = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    wide = lambda c: F.sum(c.cast("decimal(20,0)")).cast("string")
    r = df.select(one.alias("a"), two.alias("b")).agg(F.count("*").alias("n"), wide(F.col("a")).alias("a"), wide(F.col("b")).alias("b")).first()
    return _digest(df.schema.json(), r.n, r.a, r.b)


def of_code(*code: Callable | ModuleType) -> str:
    """A fingerprint of the source of functions and modules."""
    return _digest(*(inspect.getsource(c) for c in code))


def _digest(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


class Stages:
    """The stages stored under ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.hadoop = spark, path, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _records(self, name: str) -> list[tuple[int, dict]]:
        """Number and content of a stage's records, the last first."""
        folder = self.hadoop(f"{self.path}/{name}/_records")
        if not self.fs.exists(folder):
            return []
        out = []
        for at in (f.getPath() for f in self.fs.listStatus(folder)):
            number = at.getName().removesuffix(".json").split("-")[0]
            if not at.getName().endswith(".json") or not number.isdigit():
                continue
            stream = self.fs.open(at)
            try:
                out.append((int(number), at.getName(), json.loads(bytes(stream.readAllBytes()))))
            except ValueError:
                continue
            finally:
                stream.close()
        return [(n, r) for n, _, r in sorted(out, key=lambda x: x[:2], reverse=True)]

    def _record(self, name: str, number: int, record: dict) -> None:
        """A record appears whole: it is written beside and then renamed to a name that nothing else has."""
        folder = f"{self.path}/{name}/_records"
        unique = uuid.uuid4().hex
        beside, at = self.hadoop(f"{folder}/_{unique}"), self.hadoop(f"{folder}/{number:012d}-{unique}.json")
        stream = self.fs.create(beside)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        if not self.fs.rename(beside, at):
            raise OSError(f"the record of {name} couldn't be put in place")

    def fingerprint(self, name: str) -> str | None:
        """Of the last run that ended; None before one has."""
        records = self._records(name)
        return records[0][1]["fingerprint"] if records else None

    def read(self, name: str) -> dict[str, DataFrame]:
        """The tables of the last run that ended."""
        records = self._records(name)
        if not records:
            raise FileNotFoundError(f"stage {name} has no tables under {self.path}")
        last = records[0][1]
        return {t: self.spark.read.parquet(f"{self.path}/{name}/{last['folder']}/{t}") for t in last["tables"]}

    def run(self, name: str, build: Callable[[], dict[str, DataFrame]], inputs: Iterable[str] = (), settings: object = None, code: Iterable[Callable | ModuleType] = ()) -> bool:
        """Write the tables that ``build`` gives, if the stage is stale; returns whether it was.

        ``inputs`` are fingerprints: of rows, or of the stages that are read.
        """
        fingerprint = _digest(name, *inputs, repr(settings), of_code(build, *code))
        records = self._records(name)
        if records and records[0][1]["fingerprint"] == fingerprint:
            return False
        folder = uuid.uuid4().hex
        tables = build()
        for table, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{folder}/{table}")
        self._record(name, records[0][0] + 1 if records else 1, {"folder": folder, "fingerprint": fingerprint, "tables": list(tables)})
        self._clear(name)
        return True

    def _clear(self, name: str) -> None:
        """Remove the folders of records past the last ``KEPT``. Folders without a record may be of runs going on, and stay."""
        old = self._records(name)[KEPT:]
        for _, record in old:
            self.fs.delete(self.hadoop(f"{self.path}/{name}/{record['folder']}"), True)
        gone = {f"{n:012d}" for n, _ in old}
        for f in self.fs.listStatus(self.hadoop(f"{self.path}/{name}/_records")) if old else []:
            if f.getPath().getName().split("-")[0] in gone:
                self.fs.delete(f.getPath(), False)
