"""Several tables under one version: a reader sees all changes of a commit or none.

A commit writes the next state of each table that it changes to a folder of its own, then puts one small file in place
that names the folder of every table. That file is the version: what isn't named by one doesn't exist for readers, so a
commit that is broken off anywhere before leaves the version before it as it was. Of two commits on one version the
second is refused and can be made again on the new one. Old versions stay readable until ``forget``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from murmur.sources import storage


class Conflict(RuntimeError):
    """Another commit made the version first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def latest(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self._numbers(), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        text = storage.read_text(self.spark, self._file(version))
        if text is None:
            raise LookupError(f"no version {version}")
        return json.loads(text)["tables"]

    def note(self, version: int) -> dict:
        """What a commit said of itself, as JSON; empty if nothing."""
        text = storage.read_text(self.spark, self._file(version))
        return json.loads(json.loads(text)["note"] or "{}") if text else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(version)[name])

    def commit(self, changes: dict[str, DataFrame], based_on: int | None = None, note: str = "") -> int:
        """Makes the version after ``based_on`` (the newest) with the next states of some tables; the others stay. A next
        state may be made of the tables that it replaces."""
        based_on = self.latest() if based_on is None else based_on
        held = self.tables(based_on)
        made = {name: f"{self.path}/tables/{name}-{uuid.uuid4().hex}" for name in changes}
        done = False
        try:
            for name, rows in changes.items():
                rows.write.parquet(made[name])
            done = storage.create_text(self.spark, self._file(based_on + 1), json.dumps({"tables": held | made, "note": note}))
        finally:
            if not done:
                for folder in made.values():
                    storage.delete(self.spark, folder)
        if not done:
            raise Conflict(f"version {based_on + 1} exists")
        return based_on + 1

    def forget(self, before: int) -> None:
        """Deletes the versions before one, and the folders that no later version names."""
        old = [n for n in self._numbers() if n < before]
        kept = {f for n in self._numbers() if n >= before for f in self.tables(n).values()}
        gone = {f for n in old for f in self.tables(n).values()} - kept
        for n in old:
            storage.delete(self.spark, self._file(n))
        for folder in gone:
            storage.delete(self.spark, folder)

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"
