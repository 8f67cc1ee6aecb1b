"""A folder of versioned tables: each generation is complete when its manifest is there, and the newest complete one counts."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

MANIFEST = re.compile(r"manifest-(\d{8})\.json")


class Store:
    """Tables are written to a folder of their generation and named by its manifest, which is put in place by a rename.

    What a run that broke off has written is named by no manifest. A manifest of another ``version`` counts as none, so
    that the next run starts anew. Two runs at once are told apart where a rename doesn't replace a file, as on local disks and
    HDFS; on stores that copy instead, one run at a time is the caller's care. ``keep`` manifests before the newest stay with what they name, for those who still read it.
    """

    def __init__(self, spark: SparkSession, at: str, version: int, keep: int = 1):
        self.spark, self.at, self.version, self.keep = spark, at.rstrip("/"), version, keep
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)

    def _names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path())) if self._fs.exists(self._path()) else []

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.at}/{name}").first().value)

    def manifest(self) -> dict | None:
        """The newest, if it is of this version."""
        names = [n for n in self._names() if MANIFEST.fullmatch(n)]
        found = self._read(names[-1]) if names else None
        return found if found and found.get("version") == self.version else None

    def table(self, manifest: dict | None, name: str, schema: str) -> DataFrame:
        """The table's parts; empty if there is none."""
        parts = (manifest or {}).get("tables", {}).get(name, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        read = [self.spark.read.schema(schema).parquet(f"{self.at}/{p}") for p in parts]
        return reduce(DataFrame.unionByName, read)

    def begin(self) -> str:
        """The folder of the next generation."""
        taken = [int(m[1]) for n in self._names() if (m := MANIFEST.fullmatch(n))]
        return f"gen-{max(taken, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"

    def write(self, generation: str, name: str, rows: DataFrame, by: str | None = None) -> str:
        part = f"{generation}/{name}"
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.at}/{part}")
        return part

    def commit(self, generation: str, manifest: dict) -> None:
        """Puts the manifest in place; an error if another run was first. Folders that neither it nor those before it name go."""
        number = generation.split("-")[1]
        before = [n for n in self._names() if MANIFEST.fullmatch(n)][-self.keep :]
        new, final = self._path(f".{generation}.json"), f"manifest-{number}.json"
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest | {"version": self.version}).encode()))
        out.close()
        if self._fs.exists(self._path(final)) or not self._fs.rename(new, self._path(final)):
            self._fs.delete(new, False)
            raise RuntimeError(f"another run has written {final} of {self.at}")
        named = [manifest, *(self._read(n) for n in before)]
        used = {part.split("/")[0] for m in named for parts in m.get("tables", {}).values() for part in parts}
        for name in self._names():
            old = name.startswith("gen-") and name not in used and name.split("-")[1] <= number
            if old or (MANIFEST.fullmatch(name) and name != final and name not in before):
                self._fs.delete(self._path(name), True)

    def drop(self, generation: str) -> None:
        """Removes what a run has written that isn't going to commit."""
        self._fs.delete(self._path(generation), True)

    def forget(self) -> None:
        """Removes everything: the next run starts anew."""
        self._fs.delete(self._path(), True)
