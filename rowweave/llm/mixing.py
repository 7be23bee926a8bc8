"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence are mapped through the cumulative weights of the sources, which gives each slot of
the mix a source. The slots of a source are ranked, its documents are shuffled and laid end to end, and the line is cut
into blocks of equally many tokens; the slot of rank k takes block k modulo the number of blocks. A source too small for
such blocks has shorter ones of its own, as many of them as its target asks for, evenly spread between the slots.

Only DataFrame functions. A source may hold any share of the rows: running sums and ranks are taken in two levels
(within chunks of bounded size, then over the chunks' sums), so no task sees a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

GOLDEN = 0.6180339887498949
#: Slots a source at least, on average, and the largest block.
SLOTS_PER_SOURCE = 4096
MAX_BLOCK = 65536
#: Blocks that a source's words and its target consist of at least (but for blocks of one word).
BLOCKS_PER_SOURCE = 64
CHUNK = 512
CELLS = 1024


@dataclass
class Mix:
    """What a mix consists of. sources: src, source, n_docs, source_size, weight, target, length (tokens in each of its
    blocks but the last); schedule: slot, src, rank, block (a small source's blocks stand beside the slot of a large one);
    pieces: doc_id, src, size, start, block, words (of the document in the block); documents: the rows that were given, with
    src, length, size and start; block_tokens: the length of large sources' blocks."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame
    schedule: DataFrame
    block_tokens: int

    def taken(self) -> DataFrame:
        """doc_id, src, size, start and taken: how many words of each document the mix takes, repeats counted."""
        uses = self.schedule.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
        return (
            self.pieces.join(uses, ["src", "block"], "left")
            .groupBy("doc_id", "src", "size", "start")
            .agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
        )


def shares(sizes: DataFrame, weights: tuple[int, ...], ratio: float, most: float) -> DataFrame:
    """source, n_docs, source_size -> also src (place in code point order, null last), weight and target.

    The targets share ratio times all sizes by weight; none is above most times its source's size. With sources in the
    order of limit over weight, the first of them reach their limit and the others share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    out = sizes.withColumn("src", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("double"))
    out = out.withColumn("limit", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = ratio * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / weights_left)
    free = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))
    level = F.max(free).over(everything)  # the level is the same at every source that stays under its limit, but for rounding
    return out.withColumn("target", F.least("limit", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select(
        "src", "source", "n_docs", "source_size", "weight", "target"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: int = 2) -> Mix:
    """The mix of docs (doc_id, source, size: long, key: string that orders a source's documents at random).

    Repeated rows are documents of their own; null is a source like any other, the last; documents of size 0 or null take
    no part. Without words the schedule is empty. Equal input gives equal output: nothing depends on how rows lie.
    """
    docs = common.pick(docs, "doc_id", "source", "size", "key")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    sources = common.cut(shares(sizes, weights, ratio, most))
    n, total, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    total = ratio * total
    block = max(1, min(MAX_BLOCK, int(total // max(1, n * SLOTS_PER_SOURCE))))
    own = F.floor(F.least(F.col("source_size").cast("double"), "target") / BLOCKS_PER_SOURCE)
    sources = sources.withColumn("length", F.least(F.lit(block), F.greatest(F.lit(1), own)).cast("long"))
    documents = laid_out(docs.join(sources.select("src", "length", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))), largest)
    documents = common.cut(documents)
    length = F.col("length")
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)
    pieces = documents.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(F.col("start"), F.col("block") * length)
    pieces = pieces.select("doc_id", "src", "size", "start", "block", inside.alias("words"))
    return Mix(sources, documents, pieces, schedule(sources, total, block, most), block)


def laid_out(docs: DataFrame, largest: int) -> DataFrame:
    """doc_id, src, length, size, start: where each document starts when those of its source lie end to end in the order of key."""
    digits = min(8, max(1, math.ceil(math.log(max(largest, 1) / 1000, 16)))) if largest > 1000 else 1
    docs = docs.select("doc_id", "src", "length", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size")).withColumn("chunk", F.substring("key", 1, digits))
    chunks = docs.groupBy("src", "chunk").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("src", "chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("src", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(chunks, ["src", "chunk"]).select("doc_id", "src", "length", "size", (F.col("_before") + F.col("_within")).cast("long").alias("start"))


def schedule(sources: DataFrame, total: float, block: int, most: int) -> DataFrame:
    """slot, src, rank, block: slot t goes to the source in whose part of [0, 1) the fraction of (t + 0.5) golden ratios falls.

    The source is looked up by one of CELLS equal cells, so that the join is on equality. A source's slots end where it
    would take more than most times its words. Sources with shorter blocks take no part in this: their slots are counted.
    """
    spark = sources.sparkSession
    small = sources.where((F.col("target") > 0) & (F.col("length") < block))
    rest = total - (small.agg(F.sum("target")).first()[0] or 0.0)
    span = math.ceil(rest / block) or math.ceil(total / block)
    parts = sources.where((F.col("target") > 0) & (F.col("length") == block))
    up_to = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    parts = parts.withColumn("high", F.sum("target").over(up_to) / F.sum("target").over(everything))
    parts = parts.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("src")))
    parts = parts.withColumn("high", F.when(F.lead("src").over(Window.orderBy("src")).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    cells = F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))
    parts = parts.select("src", "low", "high", n_blocks.alias("n_blocks"), F.explode(cells).alias("cell"))
    slots = spark.range(math.ceil(rest / block)).withColumnRenamed("id", "slot")
    turn = (F.col("slot") + 0.5) * GOLDEN
    slots = slots.withColumn("point", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    slots = slots.join(parts, "cell").where("point >= low and point < high").select("slot", "src", "n_blocks")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = slots.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("_within", within).join(counts, ["src", "chunk"])
    rank = F.col("_before") + F.col("_within")
    ranked = ranked.select("slot", "src", rank.alias("rank"), (rank % F.col("n_blocks")).alias("block"), "n_blocks").where(F.col("rank") < most * F.col("n_blocks")).drop("n_blocks")
    return ranked.unionByName(counted(small, span, most))


def counted(small: DataFrame, span: int, most: int) -> DataFrame:
    """slot, src, rank, block of sources whose slots are counted: whole passes, and blocks of the words that are left."""
    n_blocks = F.ceil(F.col("source_size") / F.col("length")).cast("long")
    passes = F.floor(F.col("target") / F.col("source_size"))
    uses = passes * n_blocks + F.round((F.col("target") - passes * F.col("source_size")) / F.col("length"))
    small = small.select("src", n_blocks.alias("n_blocks"), F.least(uses, most * n_blocks).cast("long").alias("uses")).where("uses > 0")
    turn = (F.col("src") + 1) * GOLDEN  # else all of these sources would begin at the first slot
    small = small.withColumn("phase", turn - F.floor(turn)).withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    slot = F.floor((F.col("rank") + F.col("phase")) * span / F.col("uses"))
    return small.select(slot.alias("slot"), "src", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of documents; the sizes are counted once and kept."""
    docs = common.pick(docs, "doc_id", "text", "source")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")))
    return common.cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(common.TOKEN)), F.lit(0)).cast("long").alias("size"), key.alias("key")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. Null, empty and blank texts have size 0 and take no part; null is a source
    like any other, the last; repeated rows are documents of their own; null ids are one id."""
    mixed = mix(sized(common.table(spark, sf_dir, "documents")))
    taken = mixed.taken().select("doc_id", "src", "size", "taken")
    taken = taken.unionByName(mixed.documents.where("size = 0").select("doc_id", "src", "size", F.lit(0).cast("long").alias("taken")))
    return taken.join(mixed.sources, "src").select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents: each as often as its words are taken, rounded; those that aren't taken go.

    Rows with the same id, source and size can't be told apart by the mix and share their number of takes by rank.
    """
    mixed = mix(sized(docs))
    same = Window.partitionBy("id", "size", "src_name")
    times = mixed.taken().join(mixed.sources.select("src", F.col("source").alias("src_name")), "src")
    times = times.select(F.col("doc_id").alias("id"), "size", "src_name", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias("times"), "start")
    times = times.withColumn("nth", F.row_number().over(same.orderBy("start"))).drop("start").where("times > 0")
    size = F.coalesce(F.regexp_count("text", F.lit(common.TOKEN)), F.lit(0)).cast("long")
    own = common.packed(docs, "doc_id", "source", "text").select("doc", F.col("doc_id").alias("id"), F.col("source").alias("src_name"), size.alias("size"), F.xxhash64("text").alias("hash"))
    own = own.withColumn("nth", F.row_number().over(same.orderBy("hash")))
    taken = own.join(times, [own[c].eqNullSafe(times[c]) for c in ("id", "size", "src_name", "nth")]).select(own["doc"], times["times"])
    return common.unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)


ORACLE_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s0),
s2 AS (SELECT *, CAST(CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
       FROM s2 WINDOW w AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap, weight * max(CASE WHEN cap / weight >= level THEN level END) OVER ()) AS target FROM s3),
b AS (SELECT CAST(greatest(1, least(65536, floor(1.5 * sum(source_size) / (count(*) * 4096)))) AS BIGINT) AS block, 1.5 * sum(source_size) AS total FROM s4),
p AS (SELECT src, source_size, sum(target) OVER (ORDER BY src) / sum(target) OVER () AS high,
             coalesce(sum(target) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS low FROM s4 WHERE target > 0),
slots AS (SELECT t.t AS slot, (t.t + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE AS turn FROM (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS t FROM b) t),
placed AS (SELECT slot, src, CAST(ceil(source_size / block::DOUBLE) AS BIGINT) AS nb FROM slots, p, b WHERE turn - floor(turn) >= low AND turn - floor(turn) < high),
ranked AS (SELECT src, nb, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM placed),
uses AS (SELECT src, rank % nb AS blk, count(*) AS uses FROM ranked WHERE rank < 2 * nb GROUP BY ALL),
laid AS (SELECT doc_id, size, d.key, s4.src, s4.source_size, s4.target,
                coalesce(sum(size) OVER (PARTITION BY s4.src ORDER BY d.key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
         FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
numbered AS (SELECT *, row_number() OVER () AS r FROM laid),
pieces AS (SELECT r, src, size, start, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block + 1 AS BIGINT))) AS blk, block FROM numbered, b WHERE size > 0),
taken AS (SELECT r, sum((least(start + size, (blk + 1) * block) - greatest(start, blk * block)) * coalesce(uses, 0)) AS taken
          FROM pieces LEFT JOIN uses USING (src, blk) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM numbered LEFT JOIN taken USING (r)
"""
