"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents one after the other in a fixed order, are packed
into blocks of ``block`` words (the last one may be shorter). Targets follow from the
weights by water-filling. A source's target becomes a number of block slots. The counts
of the sources in the output shards are a multinomial draw under the condition that every
source's counts add up to its slots: each slot draws its shard. A shard's count of a
source then takes that many consecutive slot numbers, and slot j is block
``perm(j mod n_blocks)`` of the source in its pass ``j div n_blocks``, by a pseudorandom
permutation of the source's block indices. So each block is taken floor or ceil of
slots / n_blocks times, and which blocks a shard gets follows from the draws. Slots and
the documents' pieces of blocks meet in a join by (source, index).

Running sums go in two levels, so no task sees all documents or shards of a source. Only
ids and sizes take part; texts are written once and joined once, at the end.

Cases: a null text has size 0; empty documents take 0; a null source is a source of its
own, last in order; repeated rows are documents of their own; an empty table gives an
empty result; other columns are ignored, whatever their names (dots included). Numbers
are drawn by hashing (seed, source, slot), so reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import JAVA_WORD, Scratch, n_words, named, partitions, running, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK = 64
SEED = 20_011
#: Prime multipliers for index permutations; their product exceeds any long, so one of
#: them is coprime to any number of blocks (fixed values).
PRIMES = [1_000_003, 1_000_033, 1_000_037, 1_000_039]


def source_key(source: str) -> Column:
    """A null-safe key of a source that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), named(source).cast("string")), F.lit("1"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sk, source_size) plus ``target``: shares of ``share`` x all sizes by weight, at most
    ``most`` x the source's size, the excess reshared by weight until none is above.

    One row a source; the windows run over that summary only. Sorted by cap / weight, the
    sources that reach their cap are a prefix; the level of the others is the rest divided
    by their weights.
    """
    w = F.element_at(F.lit([float(x) for x in weights]).cast("array<double>"), ((F.row_number().over(Window.orderBy("sk")) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("ws", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("lam", (F.lit(share) * F.sum("source_size").over(every) - F.col("caps")) / F.col("ws"))
    level = F.min(F.when(F.col("lam") <= F.col("cap") / F.col("w"), F.struct("caps", "lam"))).over(every)
    s = s.withColumn("level", level["lam"])
    return s.select("sk", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _spread(df: DataFrame, count: str, step: int, scratch_partitions: int) -> DataFrame:
    """One row per unit 0..count-1 as ``j``, generated in runs of ``step`` on many tasks."""
    runs = df.withColumn("run", F.explode(F.expr(f"CASE WHEN {count} > 0 THEN sequence(0L, CAST(({count} - 1) DIV {step} AS BIGINT)) ELSE array() END")))
    runs = runs.repartition(scratch_partitions, "sk", "run")
    return runs.withColumn("j", F.explode(F.expr(f"sequence(run * {step}, least({count} - 1, run * {step} + {step - 1}))"))).drop("run")


def perm(j: Column, n: Column, sk: Column, seed: int) -> Column:
    """Position of ``j`` in a permutation of 0..n-1 that depends on the source and ``seed``."""
    a = F.filter(F.lit(PRIMES).cast("array<bigint>"), lambda p: n % p != 0)[0]
    # Two affine rounds with a reflection between them; each is a bijection.
    b1, b2 = (F.pmod(F.xxhash64(F.lit(seed + i), sk), n) for i in (1, 2))
    once = F.pmod(j * a + b1, n)
    turned = F.when(once % 2 == 0, F.floor(once / 2)).otherwise(n - 1 - F.floor(once / 2))
    return F.pmod(turned.cast("long") * a + b2, n)


@dataclass(frozen=True)
class Mix:
    """``rows`` (uid, doc_id, sk, size, begin, source_size, target, n_blocks, slots), one a document;
    ``shards`` (sk, shard, n, first): the drawn counts of each source in each shard; ``slots``
    (sk, shard, pass, idx): the blocks that the shards take; ``pieces`` (uid, sk, idx, start, words): the
    words [start, start + words) of a document lie in block ``idx`` of its source."""

    sized: DataFrame
    rows: DataFrame
    shards: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def placed(self) -> DataFrame:
        """(uid, start, words, shard, pass): the pieces that the mix takes, once for every time."""
        return self.pieces.join(self.slots.hint("merge"), ["sk", "idx"]).select("uid", "start", "words", "shard", "pass")


def mix(
    spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", source="source",
    weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shard_slots=4096, seed=SEED, keep_text=False,
) -> Mix:
    """The mix of ``docs``; with ``keep_text`` its ``sized`` holds their columns in a struct ``row``."""
    scratch = Scratch(spark, "mixing")
    parts = partitions(spark)
    whole = [F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row")] if keep_text else []
    sized = docs.select(F.monotonically_increasing_id().alias("uid"), named(doc_id).alias("doc_id"), source_key(source).alias("sk"), n_words(text).alias("size"), F.xxhash64(named(text)).alias("h"), *whole)
    sized = scratch.cut(sized)
    n_buckets = max(256, math.ceil(sized.count() / 1000))
    keyed = sized.drop("row").withColumn("b", F.pmod(F.xxhash64("doc_id", "size", "h"), F.lit(n_buckets)))
    sums = scratch.cut(keyed.groupBy("sk", "b").agg(F.sum("size").alias("bsize")))
    goal = targets(sums.groupBy("sk").agg(F.sum("bsize").alias("source_size")), weights, share, most)
    goal = goal.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) DIV {block}"))
    goal = scratch.cut(goal.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")))

    starts = running(sums, ["sk"], "b", "bsize", "base").drop("bsize")
    inside = Window.partitionBy("sk", "b").orderBy("doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keyed.withColumn("end", F.sum("size").over(inside)).join(starts, ["sk", "b"]).join(goal, "sk")
    rows = rows.withColumn("begin", F.col("base") + F.col("end") - F.col("size"))
    rows = scratch.cut(rows.select("uid", "doc_id", "sk", "size", "begin", "source_size", "target", "n_blocks", "slots"))

    # Counts of each source in each output shard: every slot draws its shard.
    total = goal.agg(F.sum("slots")).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard_slots))
    drawn = _spread(goal.select("sk", "slots"), "slots", 16_384, parts)
    drawn = scratch.cut(drawn.groupBy("sk", F.pmod(F.xxhash64(F.lit(seed), "sk", "j"), F.lit(n_shards)).alias("shard")).agg(F.count("*").alias("n")))
    shards = scratch.cut(running(drawn, ["sk"], "shard", "n", "first"))
    # The slot numbers of a shard, mapped through the source's permutation to block indices.
    runs = shards.join(F.broadcast(goal.select("sk", "n_blocks")), "sk").repartition(parts, "sk", "shard")  # a row a source
    j, n = F.col("j"), F.col("n_blocks")
    slots = runs.withColumn("j", F.explode(F.expr("sequence(first, first + n - 1)")))
    slots = slots.select("sk", "shard", F.floor(j / n).cast("long").alias("pass"), perm(j % n, n, F.col("sk"), seed).alias("idx"))

    pieces = rows.where("size > 0").select("uid", "sk", "begin", "size", F.explode(F.expr(f"sequence(begin DIV {block}, (begin + size - 1) DIV {block})")).alias("idx"))
    lo = F.greatest(F.col("begin"), F.col("idx") * block)
    hi = F.least(F.col("begin") + F.col("size"), (F.col("idx") + 1) * block)
    pieces = pieces.select("uid", "sk", "idx", (lo - F.col("begin")).alias("start"), (hi - lo).alias("words"))
    return Mix(sized, rows, shards, slots, pieces)


def mixed_texts(spark: SparkSession, docs: DataFrame, *, text="text", n_chars="n_chars", **how) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each pass in which the mix
    takes some of a document, whatever the shards of its blocks. A document that a pass takes
    whole keeps its text; else the text is the taken words, in order, joined by one space.
    """
    m = mix(spark, docs, text=text, keep_text=True, **how)
    taken = m.placed().groupBy("uid", "pass").agg(F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"))
    out = m.sized.select("uid", "size", "row").join(taken, "uid")
    own = F.col("row")[text]
    words = F.regexp_extract_all(own, F.lit(f"({JAVA_WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["words"].cast("int")))), " ")
    new = F.when(F.col("n") == F.col("size"), own).otherwise(cut)
    out = out.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
    return out.withColumn(n_chars, F.length(named(text)).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and in how many output shards they lie."""
    m = mix(spark, table(spark, sf_dir, "documents"))
    taken = m.placed().groupBy("uid", "shard").agg(F.sum("words").alias("n"))
    taken = taken.groupBy("uid").agg(F.sum("n").alias("taken"), F.count("*").alias("shards"))
    return m.rows.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "shards")])
