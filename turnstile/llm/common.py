"""What the operators share: reading, materialising, row keys and word rules."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, wherever an operator speaks of words (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
JAVA_WORD = r"[^\x20\x09-\x0D]+"
#: ``bytes.lower`` folds A-Z only, ``bytes.split`` splits at exactly \x20 and \x09-\x0D.
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="turnstile-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run in the shared folder.

    ``cut`` writes a frame and reads it back: the lineage ends at files that outlive
    an executor, so the shuffle files behind them go as soon as the write has ended.
    ``drop`` removes tables that nothing refers to any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        batch_rows(spark)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEAN_SHUFFLES)
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in frames:
            p = jvm.org.apache.hadoop.fs.Path(f._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def batch_rows(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Arrow batches small enough for long texts and chunks, unless the session has tighter settings.

    Batches take memory outside the JVM's heap, on both sides of the pipe.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns what this process has freed to the system. Idle Python workers wait beside the JVM and
    the next stage's workers, and else keep the most that any of their tasks took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """``run``, a function of ``mapInPandas``, with ``give_back`` at the end of each task."""

    def tidied(frames):
        try:
            yield from run(frames)
        finally:
            give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def named(column: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def n_words(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(named(text), F.lit(JAVA_WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], at: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its keys with a smaller ``at`` (a whole number).

    In two levels, groups of ``group`` places and places within a group, so no task sees all rows of a key.
    """
    df = df.withColumn("__g", F.expr(f"`{at}` DIV {group}"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__g").agg(F.sum(value).alias("__s"))
    sums = sums.select(*keys, "__g", F.coalesce(F.sum("__s").over(before(*keys).orderBy("__g")), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(value).over(before(*keys, "__g").orderBy(at)), F.lit(0))
    return df.withColumn("__in", inside).join(sums, [*keys, "__g"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__g", "__base", "__in")


def id_buckets(df: DataFrame, key: str, rows_per_bucket: int = 5000) -> tuple[list, int]:
    """Ascending cut points that deal ``key`` into ranges of about ``rows_per_bucket`` rows.

    The cut points are a bounded list (at most 65,535); they only steer the dealing, any
    list gives the same results.
    """
    n = df.count()
    want = max(1, min(1 << 16, math.ceil(n / rows_per_bucket)))
    if want == 1:
        return [], n
    probs = [i / want for i in range(1, want)]
    cuts = df.where(F.col(key).isNotNull()).approxQuantile(key, probs, 0.25 / want)
    return sorted({int(c) for c in cuts}), n


def bucket_of(key: str, cuts: list) -> Column:
    """Index of the range that ``key`` falls in; null keys come first (range -1). Cut points are looked up in two steps."""
    if not cuts:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0))
    size = max(1, math.isqrt(len(cuts)))
    parts = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    below = lambda arr: F.size(F.filter(arr, lambda c: c <= F.col(key)))
    part = F.greatest(below(F.lit([p[0] for p in parts]).cast("array<bigint>")), F.lit(1))
    fine = F.element_at(F.lit(parts).cast("array<array<bigint>>") if len(parts) > 1 else F.array(F.lit(parts[0]).cast("array<bigint>")), part)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise((part - 1) * size + below(fine))


def by_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each group in one partition, one group after the other, for ``whole_groups``."""
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def whole_groups(frames, keys: list[str]):
    """Frames that hold whole groups only, with the group bounds, from batches sorted by ``keys``.

    One call of Python for many small groups; memory follows a batch and the largest group.
    """
    import numpy as np
    import pandas as pd

    def bounds(f):
        k = [f[c].to_numpy() for c in keys]
        new = np.zeros(max(len(f) - 1, 0), bool)
        for c in k:
            new |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(f)]])

    def out(held):
        f = held[0] if len(held) == 1 else pd.concat(held)
        f = f.reset_index(drop=True)
        return f, bounds(f)

    held: list = []
    for f in frames:
        if not len(f):
            continue
        cut = int(bounds(f)[-2])
        if cut:
            yield out([*held, f.iloc[:cut]])
            held = [f.iloc[cut:]]
        elif held and any(held[-1][c].iloc[-1] != f[c].iloc[0] for c in keys):
            yield out(held)
            held = [f]
        else:
            held.append(f)
    if held:
        yield out(held)


MOST_FILTER_BITS = 1 << 28  # 32 MB


def probably_in(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose long ``key`` may occur in ``wanted``: a filter ahead of a join.

    A bitmap of hashed keys, 16 bits a wanted row and 32 MB at most, is broadcast by words
    of 64 bits. It lets some other rows through (about one in 16, all of them once
    ``wanted`` is far beyond 2^28), so the join that follows still decides; it only keeps
    rows from being shuffled.
    """
    bits = min(MOST_FILTER_BITS, 1 << (16 * wanted.count()).bit_length())

    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))

    words = wanted.select(bit(wanted_key).alias("__bit")).groupBy(F.expr("__bit DIV 64").alias("__word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(__bit % 64 as int)))").alias("__mask"))
    held = df.withColumn("__bit", bit(key)).withColumn("__at", F.expr("__bit DIV 64"))
    held = held.join(F.broadcast(words), F.col("__at") == F.col("__word"))
    return held.where("(shiftrightunsigned(__mask, cast(__bit % 64 as int)) & 1L) = 1").drop("__bit", "__at", "__word", "__mask")


def summed_in_rounds(parts: DataFrame, keys: list[str], add, size: int = 64) -> DataFrame:
    """One row for each of ``keys`` from rows (keys..., part, payload): ``add`` joins the payloads of
    up to ``size`` neighbouring parts, round after round, so no task holds more than that many."""
    import pandas as pd

    fields = [f for f in parts.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("part", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, "part": [int(f["part"].iloc[0]) // size], "payload": [add(f["payload"].tolist())]})

    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy(*keys, F.expr(f"part DIV {size}")).applyInPandas(run, schema)
        n = -(-n // size)
        if n == 1:
            return parts
