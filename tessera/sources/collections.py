"""Tables that are replaced and upserted bucket by bucket, with a commit that either happens or does not.

Rows lie in buckets by the hash of their keys. A write puts the buckets that it touches under a new version's folder
and then renames one small manifest into place, which names the version of every bucket. Readers go by the newest
manifest, so a run that fails before that leaves the table as it was, and readers of an older version keep their files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another write has committed the version that this one was about to."""


class Collection:
    """A table of rows with keys in a folder that driver and executors share, in any store that Spark reaches.

    The number of buckets is that of the first write. Keys may be null and are equal then.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _place(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest version, 0 if nothing was ever written."""
        fs, path = self._place("_manifest")
        if not fs.exists(path):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        """schema, number of buckets, and the version of each bucket that has rows."""
        fs, path = self._place(f"_manifest/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        fs, draft = self._place(f"_manifest/.{version}-{self.spark.sparkContext.applicationId}")
        _, path = self._place(f"_manifest/{version}.json")
        stream = fs.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _read(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in manifest["of"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        version = version or self.version()
        if not version:
            raise FileNotFoundError(self.path)
        return self._read(self._manifest(version))

    def _write(self, rows: DataFrame, n: int, version: int) -> list[str]:
        """Rows under a version's folder, a folder a bucket; the buckets that have rows."""
        dealt = rows.withColumn("bucket", self._bucket(n))
        dealt.repartition(n, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        fs, path = self._place(f"v={version}")
        return [f.getPath().getName().split("=")[1] for f in fs.listStatus(path) if f.getPath().getName().startswith("bucket=")]

    def replace(self, rows: DataFrame) -> int:
        """rows in place of all that was there; the new version."""
        version = self.version() + 1
        found = self._write(rows, self.buckets, version)
        self._commit(version, {"schema": rows.schema.jsonValue(), "buckets": self.buckets, "of": {b: version for b in found}})
        return version

    def upsert(self, rows: DataFrame) -> int:
        """rows in place of those with their keys, the others stay; only buckets that hold such keys are read and written."""
        return self._change(rows, rows)

    def delete(self, keys: DataFrame) -> int:
        """All rows with these keys go."""
        return self._change(keys.select(*self.keys), None)

    def _change(self, gone: DataFrame, new: DataFrame | None) -> int:
        old = self.version()
        if not old:
            if new is None:
                raise FileNotFoundError(self.path)
            return self.replace(new)
        manifest, version = self._manifest(old), old + 1
        n = manifest["buckets"]
        touched = [str(r[0]) for r in gone.select(self._bucket(n)).distinct().collect()]  # as many as there are buckets at most
        known = self._read(manifest, touched)
        keys = gone.select(*[F.col(k).alias(f"gone_{i}") for i, k in enumerate(self.keys)]).distinct()
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same &= F.col(k).eqNullSafe(F.col(f"gone_{i}"))
        kept = known.join(keys, same, "left_anti")
        after = kept if new is None else kept.unionByName(new.select(known.columns))
        found = self._write(after.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in known.schema]), n, version) if touched else []
        of = {b: v for b, v in manifest["of"].items() if b not in touched} | {b: version for b in found}
        self._commit(version, {"schema": manifest["schema"], "buckets": n, "of": of})
        return version

    def tidy(self, keep: int = 1) -> None:
        """Deletes the files that none of the last `keep` versions names, and what failed writes left."""
        last = self.version()
        live = {f"v={v}/bucket={b}" for k in range(max(1, last - keep + 1), last + 1) for b, v in self._manifest(k)["of"].items()}
        fs, root = self._place("")
        for folder in fs.listStatus(root):
            name = folder.getPath().getName()
            if not name.startswith("v="):
                continue
            own = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("bucket=")]
            kept = [p for p in own if f"{name}/{p.getName()}" in live]
            for p in own if kept else [folder.getPath()]:
                if p not in kept:
                    fs.delete(p, True)
        for k in range(1, last - keep + 1):
            fs.delete(self._place(f"_manifest/{k}.json")[1], False)
