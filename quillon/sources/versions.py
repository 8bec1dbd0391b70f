"""A store of versions that forgets: appended rows, tombstones, and compaction behind numbered manifests.

A manifest lists the folders of one state. It is written aside and renamed to the next number, which succeeds
for one writer only (on file systems that rename in one step); who loses takes the newer state and tries again.
Readers use the last manifest, so they see the state before a compaction or the one after it. Folders that the
last one does not list go with `vacuum`.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import names_in


class VersionStore:
    """Rows (keys..., created, ...) of which the last written of each key counts, unless it was removed since.

    `created` and the times of removal are numbers on one clock. Keys may be null: nulls are equal to each other.
    Of rows of a key with the same `created`, the greatest by the other columns counts; those need an order.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("domain", "skill", "version")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.rest = [c for c in self.schema.names if c not in keys and c != "created"]

    def _file(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifests(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.path}/_manifests") if n.isdigit())

    def _listed(self, number: int) -> list[str]:
        files, place = self._file(f"_manifests/{number:012d}")
        stream = files.open(place)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def state(self) -> tuple[int, list[str]]:
        """Number and folders of the last manifest."""
        numbers = self.manifests()
        return (numbers[-1], self._listed(numbers[-1])) if numbers else (0, [])

    def _publish(self, change: Callable[[list[str]], list[str]]) -> None:
        """Put a manifest changed from the last one after it; again where another writer was first."""
        jvm = self.spark._jvm
        files, aside = self._file(f"_manifests/.new-{uuid.uuid4().hex}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(aside).toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            number, folders = self.state()
            stream = files.create(aside, True)
            stream.write("\n".join(change(folders)).encode())
            stream.close()
            place = self._file(f"_manifests/{number + 1:012d}")[1]
            try:
                context.rename(files.makeQualified(aside), files.makeQualified(place), keep)
                return
            except Py4JJavaError:
                if not files.exists(place):
                    raise

    def _put(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def write(self, rows: DataFrame) -> None:
        folder = self._put(rows.select(*self.schema.names), "rows")
        self._publish(lambda folders: [*folders, folder])

    def remove(self, keys: DataFrame, at) -> None:
        """Tombstones: what was created for the keys up to `at` (a number or column) is gone."""
        at = F.lit(at) if isinstance(at, (int, float)) else at
        folder = self._put(keys.select(*self.keys, at.cast(self.schema["created"].dataType).alias("removed")), "gone")
        self._publish(lambda folders: [*folders, folder])

    def _read(self, folders: list[str]) -> DataFrame:
        rows = [f"{self.path}/{f}" for f in folders if f.startswith("rows-")]
        gone = [f"{self.path}/{f}" for f in folders if f.startswith("gone-")]
        if not rows:
            return self.spark.createDataFrame([], self.schema)
        last = F.max(F.struct("created", *self.rest)).alias("row")
        live = self.spark.read.schema(self.schema).parquet(*rows).groupBy(*self.keys).agg(last)
        if gone:
            fields = [*(self.schema[k] for k in self.keys), self.schema["created"]]
            names = [*(f"_{k}" for k in self.keys), "removed"]
            of = self.spark.read.parquet(*gone).select(*(F.col(k).cast(f.dataType).alias(n) for k, f, n in zip([*self.keys, "removed"], fields, names)))
            of = of.groupBy(*names[:-1]).agg(F.max("removed").alias("removed"))
            met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            live = live.join(of, [*met, F.col("row.created") <= F.col("removed")], "left_anti")
        return live.select(*self.keys, "row.*").select(*self.schema.names)

    def read(self) -> DataFrame:
        """The live rows of the last complete state. What is read later from it stays as it is until the next vacuum."""
        return self._read(self.state()[1])

    def compact(self) -> None:
        """Write the live rows anew and let a manifest with them take the place of all folders read; later ones stay."""
        seen = self.state()[1]
        folder = self._put(self._read(seen), "rows")
        self._publish(lambda folders: [folder, *(f for f in folders if f not in seen)])

    def vacuum(self) -> int:
        """Delete folders and manifests that the last state does not need, when no writer and no older reader is at work; bytes freed."""
        number, folders = self.state()
        kept, freed = {*folders, "_manifests"}, 0
        for name in names_in(self.spark, self.path):
            if name not in kept:
                files, place = self._file(name)
                freed += files.getContentSummary(place).getLength()
                files.delete(place, True)
        for old in (n for n in self.manifests() if n < number):
            files, place = self._file(f"_manifests/{old:012d}")
            files.delete(place, False)
        return freed

    def size(self) -> int:
        """Bytes of the folders of the last state."""
        return sum(self._file(f)[0].getContentSummary(self._file(f)[1]).getLength() for f in self.state()[1])
