"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources in code-point order (NULL last) weigh 1, 2, 3, 1, 2, ... and share all
  words; a target stops at ``MAX_REPEATS`` times its source's words, and the excess is shared
  again by weight until none is above.
* Blocks: the documents of a source, shuffled by a hash of their key, follow each other in a
  stream that is cut into blocks of ``BLOCK`` words (the last may be shorter).
* Schedule: slot i has the point frac((i + 1) x golden ratio); mapped through the cumulative
  targets it names a source. A source's slots are ranked, and its k-th slot takes its k-th
  block, going round the stream again when it is used up. A source takes exactly its target
  rounded to words: its last block is cut, surplus slots are left out and missing ones
  follow at the end (the discrepancy of the sequence, a few slots a source).

Only DataFrame operations run. Per-source order never meets in one task: documents are
ordered within hash buckets and slots within chunks, and small tables of one row per
bucket or chunk carry the running totals.

Cases: NULL and blank texts have no words and are never taken; a NULL source is a source;
repeated rows are separate documents of the stream; equal keys are ordered by their text's
hash; other columns are ignored; an empty table gives empty results.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepared, written

BLOCK = 1_024
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 4_096
CHUNK = 65_536
CELLS = 4_096
GOLDEN = "0.618033988749894848"
BLANKS = " \t\n\x0b\f\r"


def word_count(text: str) -> Column:
    """Number of runs of characters other than ASCII white space; NULL has none."""
    inner = F.btrim(F.col(text), F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


@dataclass
class Mix:
    """sizes: __row, key, text_hash, source, src, size. targets: source, src, source_size, target,
    quota, blocks. schedule: slot, src, block, round, take (words of the block). segments: src,
    block, __row, low, high (words of the block), first (words of the document before them)."""

    sizes: DataFrame
    targets: DataFrame
    schedule: DataFrame
    segments: DataFrame


def source_targets(sizes: DataFrame, block: int = BLOCK, max_repeats: int = MAX_REPEATS,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: its number, words, target, words to take and number of blocks."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    sources = written(totals.withColumn("src", number).withColumn("weight", weight.cast("double"))
                      .withColumn("cap", (F.col("source_size") * max_repeats).cast("double")), "mix-sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, before = 0.0, -1
    while True:  # one round more than there are waves of sources that reach their cap
        free = F.col("weight") * rate <= F.col("cap")
        capped, held, open_weight = sources.agg(
            F.count(F.when(~free, 1)), F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        if capped == before or not open_weight:
            break
        before, rate = capped, (words - (held or 0.0)) / open_weight
    target = F.least(F.col("cap"), F.col("weight") * F.lit(rate))
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    whole = F.expr("quota div source_size")
    left = F.col("quota") - whole * F.col("source_size")
    return written(
        sources.withColumn("target", target).withColumn("quota", quota)
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("slots", F.when(F.col("quota") > 0, whole * F.col("blocks") + F.ceil(left / block)).otherwise(0).cast("long"))
        .select("source", "src", "source_size", "target", "quota", "blocks", "slots"), "mix-targets")


def _slots(targets: DataFrame) -> DataFrame:
    """slot, src: golden-ratio points mapped through the cumulative targets."""
    count, sources, total = targets.agg(F.sum("slots"), F.count(F.lit(1)), F.sum("target")).first()
    count, total = count or 0, total or 1.0
    cells = max(CELLS, 1 << (4 * sources).bit_length())
    earlier = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (targets.withColumn("low", F.coalesce(F.sum("target").over(earlier), F.lit(0.0)) / F.lit(total))
              .withColumn("high", F.lead("low", 1, 1.0).over(Window.orderBy("src")))
              .where("low < high"))
    ranges = ranges.select("src", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"))
    point = F.expr(f"CAST((CAST(id + 1 AS DECIMAL(20, 0)) * {GOLDEN}BD) % 1BD AS DOUBLE)")
    slots = targets.sparkSession.range(count).select(F.col("id").alias("slot"), point.alias("point"))
    return (slots.withColumn("cell", F.floor(F.col("point") * cells)).join(ranges, "cell")
            .where("point >= low AND point < high").select("slot", "src"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, src, block, round, take: which block stands where, and how many of its words."""
    slots = written(_slots(targets).withColumn("chunk", F.expr(f"slot div {CHUNK}")), "mix-slots")
    counts = slots.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = (slots.withColumn("place", place).join(bases, ["src", "chunk"])
              .select("slot", "src", (F.col("base") + F.col("place")).alias("k")))
    had = counts.groupBy("src").agg(F.sum("n").alias("had"))
    short = (targets.join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
             .select("src", F.explode(F.expr("sequence(had, slots - 1)")).alias("k")))
    last = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    closing = short.select((F.lit(last) + F.col("k")).alias("slot"), "src", "k")
    return (ranked.union(closing).join(targets, "src").where("k < slots")
            .selectExpr("slot", "src", "k % blocks AS block", "k div blocks AS round", "source_size", "quota")
            .withColumn("take", F.least(
                F.lit(block), F.col("source_size") - F.col("block") * block,
                F.col("quota") - F.col("round") * F.col("source_size") - F.col("block") * block))
            .select("slot", "src", "block", "round", "take"))


def block_segments(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """src, block, __row, low, high, first: the documents' parts in the blocks of their source."""
    order = F.xxhash64(F.lit("mix"), "key")
    rows = (sizes.where("size > 0").select("src", "__row", "key", "text_hash", "size", order.alias("order"))
            .withColumn("bucket", F.expr(f"shiftrightunsigned(order, {64 - BUCKETS.bit_length() + 1})")))
    totals = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    # The hash is ordered as an unsigned number through its bucket, then as a signed one.
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = (Window.partitionBy("src", "bucket").orderBy("order", "key", "text_hash", "size", "__row")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(bases, ["src", "bucket"])
              .select("src", "__row", "size", (F.col("base") + F.col("inside")).alias("start")))
    return (placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
            .withColumn("at", F.col("block") * block)
            .select("src", "block", "__row",
                    (F.greatest("start", "at") - F.col("at")).alias("low"),
                    (F.least(F.col("start") + F.col("size"), F.col("at") + block) - F.col("at")).alias("high"),
                    (F.greatest("start", "at") - F.col("start")).alias("first")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        block: int = BLOCK, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> Mix:
    prepared(docs.sparkSession)
    sizes = written(docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(source).alias("source"),
        word_count(text).alias("size")).withColumn("__row", F.monotonically_increasing_id()), "mix-sizes")
    targets = source_targets(sizes, block, max_repeats, weights)
    numbers = targets.select(F.col("source").alias("__source"), "src")
    sizes = sizes.join(numbers, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return Mix(sizes, targets, written(schedule(targets, block), "mix-schedule"), block_segments(sizes, block))


def taken_parts(found: Mix) -> DataFrame:
    """slot, round, __row, first, words: what every slot takes of every document."""
    words = F.least("high", "take") - F.col("low")
    return (found.schedule.join(found.segments, ["src", "block"])
            .select("slot", "round", "__row", "first", words.alias("words")).where("words > 0"))


def taken_words(found: Mix, key: str = "doc_id") -> DataFrame:
    """key, size, source_size, target, taken: the words of each document in the mix, repeats counted."""
    taken = taken_parts(found).groupBy("__row").agg(F.sum("words").alias("taken"))
    return (found.sizes.join(found.targets.select("src", "source_size", "target"), "src")
            .join(taken, "__row", "left")
            .select(F.col("key").alias(key), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    **settings) -> DataFrame:
    """``docs`` with whole documents repeated: a row for each time its first word is in the mix."""
    found = mix(docs, key, text, source, **settings)
    starts = taken_parts(found).where("first = 0").groupBy("__row").agg(F.count(F.lit(1)).alias("n"))
    copies = written(found.sizes.join(starts, "__row", "left").groupBy("key", "text_hash", "source")
                     .agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0"), "mix-copies")
    rows = docs.withColumn("__hash", F.xxhash64(text))
    same = (rows[key].eqNullSafe(copies["key"]) & (rows["__hash"] == copies["text_hash"])
            & rows[source].eqNullSafe(copies["source"]))
    alone = rows.join(copies.where("rows = 1").select("key", "text_hash", "source", "copies"), same)
    chosen = alone.select(*(rows[c] for c in docs.columns), "copies")
    repeated = copies.where("rows > 1")
    if not repeated.isEmpty():
        once = rows.dropDuplicates([key, "__hash", source])
        again = (once[key].eqNullSafe(repeated["key"]) & (once["__hash"] == repeated["text_hash"])
                 & once[source].eqNullSafe(repeated["source"]))
        several = once.join(repeated.select("key", "text_hash", "source", "copies"), again)
        chosen = chosen.union(several.select(*(once[c] for c in docs.columns), "copies"))
    return chosen.withColumn("__copy", F.explode(F.expr("sequence(1, copies)"))).select(*docs.columns)
