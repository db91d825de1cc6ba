"""Mixing sources to target weights along a time-varying curriculum (operator 3).

Sources get their share of all words, capped at REPEATS times what they have. Each source's weight schedule
over training time is linear and integrates to its target; the integral, inverted at a document's place in its
source's stream of words, is the document's training position. Documents are then range-sorted by position.

No window spans a source: running word counts are made per (source, slice of the hash order) and added up
from the few slice totals, so a source with a third of all rows is spread over many tasks. Rows that share id and text are one
entry with a count; texts themselves are in no window and are joined to their places when all is placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import one_row_each, shards
from quillspark.scratch import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
REPEATS = 3
#: Bytes that a word with the space after it is taken to have.
WORD_BYTES = 8
#: Hexadecimal digits of the hash that tell the slices of a source apart: 4096 slices.
DIGITS = 3
#: How the weight of a source moves from the start to the end of training, by its place in the cycle of weights.
TILTS = (0.5, 0.0, -0.5)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, tilt) from (source, source_size), one row a source.

    In order of code points, null last, sources weigh 1, 2, .. cycle, repeating. Where a share exceeds repeats times
    its source, the source takes that much and the rest is shared anew: sorted by the share at which each is
    full, the first split at which nothing more overflows is the answer. Only the table of sources is in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1).withColumn("weight", (F.col("rank") % cycle + 1).cast("double"))
    full = (F.col("source_size") * repeats).cast("double")
    up_to = Window.orderBy(full / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    split = ranked.select(
        "*",
        full.alias("full"),
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(full).over(up_to), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))).alias("open"),
    ).withColumn("level", F.col("left") / F.col("open"))
    # The level rises with every source that is full, until a source has room for it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(full / F.col("weight"), "rank", "level"))).over(everything)["level"]
    target = F.when(level.isNull() | (F.col("full") < level * F.col("weight")), F.col("full")).otherwise(level * F.col("weight"))
    tilts = F.array(*map(F.lit, TILTS))
    return split.select("source", "source_size", target.alias("target"), tilts[(F.col("rank") % len(TILTS)).cast("int")].alias("tilt"))


def position(offset: Column, target: Column, tilt: Column) -> Column:
    """Time t in [0, 1] at which a source with weight target * (1 - tilt + 2 * tilt * t) has asked for offset words."""
    asked = offset / F.greatest(target, F.lit(1e-9))
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - tilt) * (1 - tilt) + 4 * tilt * asked))
    return F.when(tilt == 0, asked).otherwise((root - (1 - tilt)) / F.when(tilt == 0, F.lit(1.0)).otherwise(2 * tilt))


def _key(source: str) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def row_hash() -> Column:
    """What orders a source's stream: rows with equal ids (or none) and different texts are spread like all others."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(of("doc_id"), F.lit(":"), F.md5(of("text").cast("binary"))).cast("binary"))


def _placed(documents: DataFrame, cycle: int, repeats: int) -> tuple[DataFrame, DataFrame]:
    """The written entries, and (doc_id, source, size, h, copies, source_size, target, tilt, start): start is the place of the first
    of an entry's copies rows."""
    scratch = Scratch(documents.sparkSession, "mix")
    h = row_hash()
    sized = documents.select("doc_id", "source", word_count("text").alias("size"), h.alias("h"), _key("source").alias("key"))
    entries = scratch.table(sized.groupBy("key", "h", "doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("slice", F.substring("h", 1, DIGITS)), "entries")
    words = F.col("size") * F.col("copies")
    slices = entries.groupBy("key", "slice").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("key", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    sources = entries.groupBy("source").agg(F.sum(words).alias("source_size"))
    targets = source_targets(sources, cycle, repeats).select(_key("source").alias("key"), "source_size", "target", "tilt")
    bases = slices.join(targets, "key")
    within = Window.partitionBy("key", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = entries.withColumn("inner", F.sum(words).over(within)).join(bases, ["key", "slice"])
    return entries, placed.select("doc_id", "source", "size", "h", "copies", "source_size", "target", "tilt", (F.col("base") + F.col("inner") - words).alias("start"))


def mix_plan(documents: DataFrame, cycle: int = 3, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, start, tilt, h, copies, first_position, last_position: a row for each document.

    A source's documents form a stream in order of row_hash() (ties: id, then size), repeated until the target is reached; a
    document's part of the last pass may be cut. taken: how many words of it the mix takes; start: its place in the first
    pass; first_position and last_position: training positions in [0, 1] at which its first and its last taken copy begin, null
    where nothing is taken. A null text has size 0 and nothing of it is taken; a null source is a source of its own, the last;
    null and repeated ids are like others; repeated rows are separate documents, one after another in the stream; reruns agree.
    Very long texts count whole. An empty table gives no rows. Other columns are not read.
    """
    return _plan(_placed(documents, cycle, repeats)[1])


#: Longest array that numbers a row's copies; more are numbered in two levels.
NUMBERED = 4096


def _numbered(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, numbered from 0: blocks first, then those within each, so that no array is long."""
    many = df.select("*", n.cast("long").alias("_n"))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    blocks = many.where("_n > 0").select("*", upto(F.ceil(F.col("_n") / NUMBERED)).alias("_block"))
    return blocks.select("*", upto(F.least(F.lit(NUMBERED), F.col("_n") - F.col("_block") * NUMBERED)).alias("_inner")).withColumn(name, F.col("_block") * NUMBERED + F.col("_inner")).drop("_n", "_block", "_inner")


def _plan(placed: DataFrame) -> DataFrame:
    each = _numbered(placed, F.col("copies"), "copy")
    start = F.col("start") + F.col("copy") * F.col("size")
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = words - passes * F.col("source_size")
    taken = (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))).cast("long")
    plan = each.withColumn("start", start).withColumn("taken", taken)
    last = F.floor((F.col("taken") - 1) / F.greatest(F.col("size"), F.lit(1)))
    at = lambda n: F.when(F.col("taken") > 0, position(F.col("start") + n * F.col("source_size"), F.col("target"), F.col("tilt")))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", "start", "tilt", "h", "copies", at(F.lit(0)).alias("first_position"), at(last).alias("last_position"))


def by_position(df: DataFrame, *order: str, text_bytes: int = 0) -> DataFrame:
    """df range-sorted: files or partitions in training order, each in order; as many as so many bytes of text need."""
    n = shards(df.sparkSession, text_bytes)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def mixed_documents(documents: DataFrame, cycle: int = 3, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: the columns of documents, a row for each time a document is taken, range-sorted by position.

    A row that is taken in part keeps its first words, with the white space after each, and its n_chars follows
    (where documents have that column). Documents of which nothing is taken are left out. Of rows that share source, id and text,
    the first in order of all columns (as JSON) stands for all. Cases as in mix_plan; extra columns stay as they are, whatever their names.
    """
    entries, placed = _placed(documents, cycle, repeats)
    plan = _plan(placed).where("taken > 0")
    each = _numbered(plan.select("*", _key("source").alias("key")), F.floor((F.col("taken") - 1) / F.col("size")) + 1, "pass")
    at = position(F.col("start") + F.col("pass") * F.col("source_size"), F.col("target"), F.col("tilt"))
    each = each.select("key", "h", "copies", "size", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")).alias("part"), at.alias("at"))
    row = documents.select(F.struct(*documents.columns).alias("row"), row_hash().alias("h"), _key("source").alias("key"))
    # Texts are shuffled once, to their places; rows that stand several times, where there are any, are made one beforehand.
    columns = ["row", "h", "size", "part", "at"]
    taken = row.join(each.where("copies = 1"), ["key", "h"]).select(*columns)
    if not entries.where("copies > 1").isEmpty():
        several = each.where("copies > 1")
        one = row.join(several.select("key", "h").distinct(), ["key", "h"], "left_semi")
        one = one_row_each(one, "key", "h")
        taken = taken.union(one.join(several, ["key", "h"]).select(*columns))
    text = F.col("row.text")
    pieces = F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    cut = F.when(F.col("part") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), (F.col("part") + lead).cast("int")), "")).otherwise(text)
    made = {c: F.col(f"row.`{c}`") for c in documents.columns} | {"text": cut}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.length(cut).cast(documents.schema["n_chars"].dataType)
    out = taken.select(F.struct(*(v.alias(c) for c, v in made.items())).alias("row"), "at", "h")
    words = entries.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    return by_position(out, "at", "h", text_bytes=repeats * words * WORD_BYTES).select("row.*")
