"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Sizes are words.  Sources in code-point order (null last) have the weights of ``WEIGHTS``, repeating.  All sizes are
shared by weight; a target stops at ``CAP`` times the source's size and the excess is shared again by weight, until none
is above.  This is one level: the target is the smaller of cap and weight times a rate, and the rate grows from round to
round by sums over the table of sources, until no other source reaches its cap.

Every document of a source first gets the whole copies that fit the target, floor(target / size) of all of them.  The
rest of the target, less than the source's size, is a sample of fixed size in words.  A document's inclusion odds are
those of the part that is left, times size / (size + ``HALF``), so that a fragment of a few words is less likely than a
long text.  Its rank is u / (1 - u) divided by these odds, u being uniform from a hash of doc_id.  Documents of a source
enter by rank until the words are spent; the last one gives the words that are still missing.  So each source's words
are its target rounded, and a document never gives more than ``CAP`` times its size.

No window spans a source: sizes are summed by ``BUCKETS`` ranges of rank, so only the documents of the range where the
words run out are put in order.  Documents with the same doc_id and size are the same to the sample: the group at the
cut shares what is left evenly, fractions dropped.  Every decision is a function of the row and of its source's cut, so
reruns agree.  A null doc_id has a rank as any other value; null texts have size 0; sources without words have target 0.
Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.storage import drop, save

WEIGHTS = (1, 2, 3)
CAP = 3
HALF = 32
BUCKETS = 1 << 14
#: Sources beyond this number are joined by a shuffle instead of a broadcast (some MB).
BROADCAST_SOURCES = 50_000


def uniform(of: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of a string."""
    return (F.conv(F.substring(F.md5(of), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (the source, never null), size (words), chance (u / (1 - u), over the share of the odds that the size has)."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    source = F.col("source").cast("string")
    rows = docs.select("doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), words.alias("size"), u.alias("u"))
    odds = F.col("size") / (F.col("size") + HALF)
    return rows.select("doc_id", "source", "key", "size", F.when(F.col("size") > 0, F.col("u") / (1 - F.col("u")) / odds).alias("chance"))


def weighed(sources: DataFrame) -> DataFrame:
    """key, source_size, weight of sources (key, source, source_size), numbered by ranges of a sort, so no task holds them all."""
    ranged = save(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mixing-sources")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per partition of the sort
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    number = (F.create_map(*offsets)[part] if offsets else F.lit(0)) + F.col("at") % (1 << 33)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int"))
    return ranged.select("key", "source_size", weight.alias("weight"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to sources (source_size, weight)."""
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    capped, rest, rate = 0, weights, 0.0
    while rest:
        rate = (total - capped) / rest
        full = sources.where(CAP * F.col("source_size") < F.col("weight") * F.lit(rate))
        held, gone = full.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (CAP * held, weights - gone) == (capped, rest):
            break
        capped, rest = CAP * held, weights - gone
    return sources.withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), F.col("weight") * F.lit(rate)))


def cuts(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """key, cut (chance, doc_id and size of the document where the words run out), share (words that a document at the cut gives), of sources with missing words."""
    small = F.broadcast if few else (lambda table: table)
    # What the inclusion odds of a source's documents have in common does not change their order.
    bucket = F.least(F.floor(F.col("chance") / (1 + F.col("chance")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    worded = rows.where("size > 0").withColumn("bucket", bucket)
    summed = worded.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = "coalesce(sum({}) OVER (PARTITION BY key ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    summed = summed.withColumn("before", F.expr(before.format("words", "bucket")))  # at most BUCKETS rows a source
    open_ = sources.where("missing > 0").select("key", "missing")
    at = summed.join(small(open_), "key").where("before < missing and before + words >= missing")
    at = save(at.select("key", "bucket", (F.col("missing") - F.col("before")).alias("left")), "mixing-buckets")
    groups = worded.join(small(at), ["key", "bucket"]).groupBy("key", "left", "chance", "doc_id", "size").agg(F.count("*").alias("many"))
    placed = groups.withColumn("before", F.expr(before.format("size * many", "chance, doc_id, size"))).where("before < left and before + size * many >= left")
    out = save(placed.select("key", F.struct("chance", "doc_id", "size").alias("cut"), F.expr("(left - before) div many").alias("share")), "mixing-cuts")
    drop(at)
    return out


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies (the whole ones of taken) of every row of documents."""
    rows = save(measured(docs), "mixing-rows")
    sources = targets(weighed(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("missing", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    sources = save(sources, "mixing-targets")
    few = sources.count() <= BROADCAST_SOURCES
    placed = sources.drop("weight", "missing").join(cuts(rows, sources, few), "key", "left")
    joined = rows.join(F.broadcast(placed) if few else save(placed, "mixing-placed"), "key")
    own = F.struct("chance", "doc_id", "size")
    more = F.when(own < F.col("cut"), F.col("size")).when(own.eqNullSafe(F.col("cut")), F.col("share")).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + more).otherwise(0)
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")).withColumn("copies", copies)
