"""Mixing sources to target weights by pivotal dependent rounding [native].

A source of size S (words) and target T takes each of its documents
``floor(T / S)`` times for certain and once more with the fractional rest. The
fractional copies are rounded dependently: two documents meet, and as many
words of expectation as can be are moved from one to the other, in a random
direction that keeps both expectations, until one of the two holds none or all
of its words. That one is decided, the other goes on. The last one of a
source goes to the nearer side, so its taken words differ from its target by half a
document at most.

Documents meet in blocks of about ``block``; every block leaves one undecided
document, and these meet again in blocks, level by level (a reduction tree of
log(n) levels, no level with a group that grows with the data). Rows that share
an id, or have none, are dealt to blocks by their rank among their equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, keyed, uniform, written

#: Bytes of the sources' names and figures beyond which they are joined by shuffle rather than broadcast.
BROADCAST_BYTES = 8 << 20


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0) -> DataFrame:
    """(source, source_size, rows, target): one row per source, null being a source.

    Weights are dealt to the sources in code point order, null last, repeating.
    A target stops at ``cap`` times its source's size; the excess is shared
    again by weight. The common level L, with target = min(cap * size, L *
    weight), is found with one sort by cap * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(in_order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    everything = Window.partitionBy()
    by_level = Window.orderBy("full_at", "rank")
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    per = per.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    open_at = F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "rank", "level"))
    per = per.withColumn("final", F.min(open_at).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("weight")))
    return per.select("source", "source_size", "rows", target.alias("target"))


def _meet(items: Column, seed: int) -> Column:
    """Round an array of (h, doc_id, size, mass, row): struct(kept item, array of decided items).

    A decided item's mass is 0 or its size.
    """

    def with_mass(item: Column, mass: Column) -> Column:
        return F.struct(item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["size"].alias("size"), mass.alias("mass"), item["row"].alias("row"))

    def step(acc: Column, new: Column) -> Column:
        old = acc["on"]
        to_old = F.least(old["size"] - old["mass"], new["mass"])  # what the old one can still take
        to_new = F.least(old["mass"], new["size"] - new["mass"])
        u = uniform(old["h"], new["h"], F.lit(seed))
        take = u * (to_old + to_new) < to_new  # E[old] = mass, as P(take) = to_new / (to_old + to_new)
        old_full = to_old == old["size"] - old["mass"]
        old_empty = to_new == old["mass"]
        size = lambda x: x["size"].cast("double")
        zero = F.lit(0.0)
        decided = (
            F.when(take & old_full, with_mass(old, size(old)))
            .when(take, with_mass(new, zero))
            .when(old_empty, with_mass(old, zero))
            .otherwise(with_mass(new, size(new)))
        )
        goes_on = (
            F.when(take & old_full, with_mass(new, new["mass"] - to_old))
            .when(take, with_mass(old, old["mass"] + to_old))
            .when(old_empty, with_mass(new, new["mass"] + to_new))
            .otherwise(with_mass(old, old["mass"] - to_new))
        )
        return F.struct(goes_on.alias("on"), F.concat(acc["done"], F.array(decided)).alias("done"))

    kind = "array<struct<h:bigint,doc_id:bigint,size:bigint,mass:double,row:bigint>>"
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(items[0].alias("on"), F.array().cast(kind).alias("done")), step)


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``, a row's place among the rows of equal source, doc_id and size, counted part by part of the input, so that no task has all of them."""
    equal = ["source", "doc_id", "size"]
    own = sizes.withColumn("own", F.row_number().over(Window.partitionBy(*equal, "part").orderBy("row")) - 1)
    of_part = sizes.groupBy(*equal, "part").agg(F.count("*").alias("n"))
    before = of_part.withColumn("before", F.sum("n").over(Window.partitionBy(*equal).orderBy("part")) - F.col("n")).filter("before > 0")
    before = before.select(*[F.col(c).alias(f"_{c}") for c in (*equal, "part")], "before")
    same = [own[c].eqNullSafe(before[f"_{c}"]) for c in (*equal, "part")]
    ranked = own.join(before, same[0] & same[1] & same[2] & same[3], "left")
    return ranked.select(*equal, "row", (F.col("own") + F.coalesce("before", F.lit(0))).alias("rank"))


def _drawn(docs: DataFrame, weights, share: float, cap: float, block: int, seed: int) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, copies) for rows (row, doc_id, text, source)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    part = F.shiftright(F.monotonically_increasing_id(), 33)  # of the input, not too many rows for a task
    sizes = written(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), part.alias("part")), "mix-sizes")
    per = written(source_targets(sizes, weights, share, cap).withColumn("source_no", F.xxhash64("source")), "mix-sources")
    n_bytes, most_rows = per.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.max("rows")).first()
    side = F.broadcast(per) if (n_bytes or 0) <= BROADCAST_BYTES else per
    ranked = _ranked(sizes)
    rows = ranked.join(side, ranked["source"].eqNullSafe(per["source"])).select("row", "rank", "doc_id", "size", per["source"], "source_size", "target", "rows")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(times)).withColumn("mass", (times - F.floor(times)) * F.col("size"))
    key = ["source", "source_size", "target", "whole"]
    item = F.struct(F.xxhash64("doc_id", "size", "rank", F.lit(seed)).alias("h"), "doc_id", "size", "mass", "row")
    n_blocks = F.ceil(F.col("rows") / F.lit(block))
    level = rows.select(*key, item.alias("item"), F.pmod(F.xxhash64("doc_id", "size", "rank", F.lit(-seed)), n_blocks).alias("block"))
    decided, blocks, depth = [], -(-(most_rows or 1) // block), 0
    while True:
        met = level.groupBy(*key, "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        met = met.select(*key, "block", _meet(F.col("items"), seed + depth).alias("met"))
        on = F.array(F.struct(F.lit(True).alias("open"), F.col("met.on").alias("item")))
        done = F.transform("met.done", lambda x: F.struct(F.lit(False).alias("open"), x.alias("item")))
        table = written(met.select(*key, "block", F.inline(F.concat(on, done))), f"mix-level{depth}")
        decided.append(table.filter(~F.col("open")))
        if blocks == 1:
            decided.append(table.filter("open"))  # one document per source
            break
        level = table.filter("open").select(*key, "item", F.floor(F.col("block") / F.lit(block)).alias("block"))
        blocks, depth = -(-blocks // block), depth + 1
    everything = decided[0]
    for more in decided[1:]:
        everything = everything.unionByName(more)
    drawn = F.col("item.mass") * 2 > F.col("item.size")  # the last one goes to the nearer side
    copies = F.col("whole") + F.when(F.col("item.size") > 0, drawn.cast("long")).otherwise(0)
    return everything.select("item.row", "item.doc_id", "item.size", "source_size", "target", (copies * F.col("item.size")).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of ``docs``.

    ``docs`` needs doc_id, text, source; other columns are not read. A null text
    has size 0 and takes nothing; a null source is a source, last in order. Rows
    of the same id, or without one, are separate documents, each with a draw of its own. Texts of any
    length are read whole. Empty input gives an empty result. Reruns agree: the draw depends on sources, ids, sizes
    and ``seed`` alone, as a table of rows; of rows that are equal in all of them it doesn't matter which is which.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source")
    return _drawn(rows, weights, share, cap, block, seed).drop("row")


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it. All columns are kept, whatever their names."""
    row, n = fresh(docs, "_row"), fresh(docs, "_n")
    columns = docs.columns
    docs = keyed(docs, row, "mix-documents")
    drawn = _drawn(docs.select(F.col(row).alias("row"), "doc_id", "text", "source"), weights, share, cap, block, seed)
    taken = drawn.filter("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(n))
    return docs.join(taken, row).select(*columns, F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(n)).select(*columns)
