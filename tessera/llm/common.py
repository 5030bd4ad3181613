"""What the operators of this subpackage share: staging tables, byte-level text rules and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_local, prepare

_LOCAL: list[str] = []
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate() table that lower-cases A-Z and leaves every other byte, so UTF-8 stays valid.
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the one in spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder, and a cluster gets a folder below the warehouse, never a machine-local one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not is_local(spark):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_scratch"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


class Staged:
    """A table written once to the shared folder and read back: its lineage is cut and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, wide: bool = False):
        """wide: rows may have megabytes, so the writer looks at its buffer after each."""
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        options = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "zstd"} if wide else {}
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


class Scratch:
    """The staged tables of one call; they are deleted once its result is staged itself."""

    def __init__(self) -> None:
        self.held: list[Staged] = []

    def stage(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        self.held.append(Staged(df, name, wide))
        return self.held[-1].df

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        for s in self.held:
            s.drop()
        self.held.clear()
        return out


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as make them new to docs, in any letter case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; all-ASCII texts take the fast built-in, which then means the same."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def crc_mod(value: object, mod: int) -> int:
    """crc32 of the value as decimal text, modulo mod; null counts as the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % mod


def crc_mod_col(col: Column, mod: int) -> Column:
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def text_bytes(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes the empty text."""
    import pyarrow as pa

    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batch, column: str, size: int) -> Iterator:
    """The batch in runs of rows of about size bytes of text; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def freeing(run: Callable[[Iterator], Iterator], clear: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run for a mapInArrow whose worker gives its memory back at the task's end: workers outlive their tasks, and what one operator's caches hold the next one lacks."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            if clear:
                clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim:
                trim(0)

    return whole


def components(edges: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of undirected edges (a, b: bigint): one row (node, root) per node that has an edge.

    Every round maps each node to the neighbour (or itself) that comes first in a random order, then
    contracts the edges; a constant share of the nodes goes each round, whatever the graph's diameter.
    Only aggregates and equi-joins run, so hubs are pre-aggregated on the map side and skewed joins can
    be split; each round is written to the shared folder and nothing is collected but an emptiness test.
    The rounds' maps, each smaller than the one before, are then joined from the last to the first.
    """
    maps, round_no, scratch = [], 0, scratch or Scratch()
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = Staged(tidy(edges), f"{name}-edges0")
    while round_no == 0 or not now.df.isEmpty():
        order = lambda c, r=round_no: F.struct(F.xxhash64(c, F.lit(r)).alias("p"), c.alias("n"))
        both = now.df.union(now.df.select("b", "a"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("m"))
        to = scratch.stage(best.select("node", F.least(F.col("m"), order(F.col("node")))["n"].alias("root")), f"{name}-map{round_no}")
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = Staged(tidy(now.df.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), f"{name}-edges{round_no + 1}")
        now.drop()
        now, round_no = new, round_no + 1
    now.drop()
    out = maps.pop()
    while maps:
        step = out.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = maps.pop().join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        if len(maps) % 6 == 5:
            out = scratch.stage(out, f"{name}-roots")
    return out
