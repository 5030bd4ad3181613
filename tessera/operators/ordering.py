"""Order-dependent operators: first wins, caps, runs, folds, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return cap_per(rows, keys, order, 1)


def cap_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def best_by_score(rows: DataFrame, key: str, score: str, place: str) -> DataFrame:
    """One row a key: the highest score, nulls last, the earliest of equals; rows without key go."""
    return first_per(rows.where(F.col(key).isNotNull()), [key], [F.desc_nulls_last(score), F.asc(place)])


def islands(rows: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """rows with island: a number that rises where the distance to the row before exceeds gap."""
    w = Window.partitionBy(*keys).orderBy(at, *[c for c in rows.columns if c != at][:1])
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def take_while_above(rows: DataFrame, value: str, key: str, factor: float = 2.0, most: int = 3) -> DataFrame:
    """Of the `most` highest rows those up to the first not strictly above mean + factor x sample deviation of all rows."""
    edge = rows.agg((F.avg(value) + factor * F.stddev_samp(value)).alias("edge"))
    top = rows.orderBy(F.desc(value), key).limit(most).join(F.broadcast(edge))
    w = Window.orderBy(F.desc(value), key)
    return top.withColumn("__ok", F.min((F.col(value) > F.col("edge")).cast("int")).over(w)).where("__ok = 1").drop("__ok", "edge")


def large_groups(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """Groups larger than mean + 3 sample deviations of the other groups, of which there must be two or more."""
    all_of = sizes.agg(F.count("*").alias("c"), F.sum(F.col(n).cast("double")).alias("s"), F.sum(F.col(n).cast("double") * F.col(n)).alias("q"))
    x = sizes.join(F.broadcast(all_of))
    k, mean = F.col("c") - 1, (F.col("s") - F.col(n)) / (F.col("c") - 1)
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col(n) * F.col(n) - k * mean * mean) / (k - 1)))
    return x.where("c >= 3").where(F.col(n) > mean + 3 * spread).select(*sizes.columns)


def hash_order(key: Column, seed: int | str) -> Column:
    """A random-looking order that any engine can repeat: MD5 of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def sample_n(rows: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """n rows without replacement by hash order; too few rows are an error."""
    out = rows.orderBy(hash_order(F.col(key), seed), key).limit(n)
    if out.count() < n:
        raise ValueError(f"cannot sample {n} rows")
    return out


def sample_per(rows: DataFrame, keys: list[str], key: str, n: int, seed: int | str) -> DataFrame:
    return cap_per(rows, keys, [hash_order(F.col(key), seed), F.col(key)], n)


def sample_to_size(rows: DataFrame, key: str, size: str, target: int, seed: int | str, buckets: int = 256) -> DataFrame:
    """Rows in hash order while their running size stays within target. Whole hash buckets are summed first, so only
    the bucket where the target falls is sorted in one place."""
    h = rows.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__b", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int") % buckets)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy("__b").agg(F.sum(size).alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    run = Window.partitionBy("__b").orderBy("__h", key)
    out = h.join(F.broadcast(sums), "__b").where(F.col("__before") <= target)
    return out.where(F.col("__before") < target).withColumn("__run", F.col("__before") + F.sum(size).over(run)).where(F.col("__run") <= target).drop("__h", "__b", "__s", "__before", "__run")


def split_rows(rows: DataFrame, key: str, share: float, seed: int | str) -> DataFrame:
    """rows with split: 'train' for about that share of the keys, by hash, else 'validation'."""
    bucket = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(16**8)
    return rows.withColumn("split", F.when(bucket < share, "train").otherwise("validation"))


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """The first n rows in hash order, for n that may be large: buckets of hashes are counted first, and only the one where n falls is sorted."""
    h = rows.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, 3))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = h.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", before)  # at most 4096 rows
    both = h.join(F.broadcast(counts), "__b")
    whole = both.where(F.col("__before") + F.col("__n") <= n)
    edge = both.where((F.col("__before") < n) & (F.col("__before") + F.col("__n") > n))
    edge = edge.withColumn("__p", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))).where(F.col("__before") + F.col("__p") <= n)
    return whole.select(rows.columns).unionByName(edge.select(rows.columns))


def balanced(inputs: list[DataFrame], key: str, seed: int | str) -> DataFrame:
    """The inputs cut to the size of the smallest, in hash order, one below the other."""
    n = min(df.count() for df in inputs)
    out = None
    for i, df in enumerate(inputs):
        part = first_by_hash(df, key, n, seed).withColumn("input", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def percentages(rows: DataFrame, group: str, level: str, tokens: str) -> DataFrame:
    """Scores as percentages of their group with a size factor, rounded half to even before and after they are made to sum to 100."""
    w = Window.partitionBy(group)
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    p = F.bround(F.col(level) * 100.0 / one(F.sum(level).over(w)) * F.least(F.lit(1.0), F.col(tokens) / 1500.0), 2)
    rows = rows.withColumn("__p", p)
    return rows.withColumn("percentage", F.bround(F.col("__p") * 100.0 / one(F.round(F.sum("__p").over(w), 6)), 2)).drop("__p")


def pack_greedy(sizes: Column, most: int) -> Column:
    """Group number of each size when a group is closed as soon as the next size would overflow it."""

    def step(acc: Column, n: Column) -> Column:
        over = (acc["room"] + n > most) & (acc["room"] > 0)
        group = F.when(over, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.concat(acc["out"], F.array(group)).alias("out"), group.alias("group"), F.when(over, n).otherwise(acc["room"] + n).alias("room"))

    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("room"))
    return F.aggregate(sizes, zero, step)["out"]


def oversample(rows: DataFrame, condition: Column, key: str, n: int, times: int, seed: int | str) -> DataFrame:
    """Up to n rows that fulfil the condition, out of times x n drawn in hash order."""
    order = [hash_order(F.col(key), seed), F.col(key)]
    return rows.orderBy(*order).limit(n * times).where(condition).orderBy(*order).limit(n)


def two_stage(rows: DataFrame, group: str, key: str, n: int, seed: int | str) -> DataFrame:
    """One row of each of n groups, both drawn in hash order."""
    groups = rows.select(group).distinct()
    picked = groups.orderBy(hash_order(F.col(group), seed), group).limit(n)
    return sample_per(rows.join(picked, group, "left_semi"), [group], key, 1, seed)


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 1 in an order over all of them: ranges of the order are sorted side by side, and only
    the ranges' sizes are summed in one place. Rows that tie take places in no set order."""
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    ranges = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    both = ranges.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")  # a row a partition
    return both.withColumn(name, (F.col("__before") + own).cast("bigint")).drop("__range", "__before")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with a number from 1 over all of them by group and order, null groups first; groups may be as many as rows or hold a large share of them."""
    return placed(rows, [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]], name)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """left with name: value of the last row of right with the same key at or before its time; of several at one time the
    largest. Both sides are put in order together, so a key's rows are sorted once and never meet pairwise."""
    marks = right.groupBy(key, at).agg(F.max(value).alias("__v"))
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__s", F.lit(1)).unionByName(marks.withColumn("__s", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(w)).where("__s = 1").drop("__v", "__s")
