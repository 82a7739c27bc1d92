"""Document fingerprints as Merkle trees over sections, paragraphs and their pieces [native].

Blank lines divide a text into sections, line breaks a section into paragraphs, and
every ``LEAF`` code points a paragraph into leaves. A paragraph's node is the
SHA-256 of its text, a section's that of its paragraphs' nodes, the root that of the
sections' nodes. A fingerprint is written ``root:section|section``, a section
as ``paragraph/paragraph``, a paragraph as the short digests of its leaves.
Equal roots mean equal texts; differing branches say where an edit lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform, written

LEAF = 48
_SHORT = 8
#: Code points of the texts of a bucket, as far as MOST_BUCKETS allows: their bounds are part of the plan (80 bytes each).
BUCKET_CHARS = 4 << 20
MOST_BUCKETS = 16_384
#: Rows of a table of 120 bytes a row at most, below which it is broadcast.
BROADCAST_ROWS = 100_000


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text without nulls."""
    sections = F.split(text, r"\n[ \t\r]*\n", -1)
    paragraphs = F.transform(sections, lambda s: F.split(s, "\n", -1))
    root = F.sha2(F.array_join(F.transform(paragraphs, lambda s: F.sha2(F.array_join(F.transform(s, lambda p: F.sha2(p, 256)), "/"), 256)), "|"), 256)
    # the blank lines themselves are part of the root, so that texts which differ there alone differ
    root = F.sha2(F.concat(root, F.lit(":"), F.array_join(F.regexp_extract_all(text, F.lit(r"\n[ \t\r]*\n"), 0), "|")), 256)
    leaves = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), 0), lambda x: F.substring(F.md5(x), 1, _SHORT)), "")
    return F.concat(root, F.lit(":"), F.array_join(F.transform(paragraphs, lambda s: F.array_join(F.transform(s, leaves), "/")), "|"))


def _leaves(mark: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring(mark, 66, 1 << 30), F.lit(f"[0-9a-f]{{{_SHORT}}}"), 0))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two fingerprints have in common, of those of both; 1 for equal roots. 0 if one side has no leaf."""
    x, y = _leaves(a), _leaves(b)
    total = F.size(x) + F.size(y)
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return F.when(same, 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections whose branches differ."""
    x, y = (F.split(F.substring(m, 66, 1 << 30), r"\|", -1) for m in (a, b))
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))


def _place(doc_id: Column, digest: Column) -> Column:
    """A string that ascends where documents stand in order: descending doc_id, null last, then the text's digest."""
    upward = F.bitwise_not(doc_id).bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned digits, without overflow
    return F.concat(F.coalesce(F.lpad(F.hex(upward), 16, "0"), F.lit("none")), F.lit("-"), digest)


def _bucket(place: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are not above ``place``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(bounds)), ",")  # constant: folded into the plan
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    reached = lambda at, step: F.coalesce(F.get(table, at + step - 1) <= place, F.lit(False))
    return F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at)), F.lit(0))


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, times, fingerprint, next): every distinct row (doc_id, text) once, how many ``times`` it stands there, and fingerprint and text of the document next in order; and the most times.

    Order: descending doc_id, null last, then the text's digest; after the last
    document comes the first. Rows of equal id and text are each other's next but for one.

    Buckets of neighbours have bounds drawn from the documents' own ids, so that
    ids may lie anyhow. Texts are shuffled once, to their buckets. The first
    document of a bucket stands once more, as a ghost, behind the last one of the
    bucket before, so no task has to see all documents.
    """
    digest = F.sha2("text", 256)
    keys = written(docs.select("doc_id", digest.alias("digest"), F.length("text").cast("long").alias("n")), "merkle-keys")
    rows, chars = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    repeats = written(keys.groupBy("doc_id", "digest").agg(F.count("*").alias("times")).filter("times > 1"), "merkle-repeats")
    n_repeats, most = repeats.agg(F.count("*"), F.coalesce(F.max("times"), F.lit(1))).first()
    docs = docs.withColumn("digest", digest)
    if n_repeats:
        side = repeats.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "times")
        docs = docs.join(F.broadcast(side) if n_repeats <= BROADCAST_ROWS else side, docs["doc_id"].eqNullSafe(side["_id"]) & (docs["digest"] == side["_digest"]), "left").drop("_id", "_digest")
        # copies are combined before they are shuffled
        docs = docs.filter("times IS NULL").withColumn("times", F.lit(1).cast("long")).unionByName(docs.filter("times > 1").dropDuplicates(["doc_id", "digest"]))
    else:
        docs = docs.withColumn("times", F.lit(1).cast("long"))

    n_buckets = int(min(MOST_BUCKETS, max(1, -(-chars // BUCKET_CHARS), min(rows // 64, 8))))
    place = _place(F.col("doc_id"), F.col("digest"))
    drawn = keys.filter(uniform(F.col("doc_id"), F.col("digest")) < 8 * n_buckets / max(rows, 1)).select(place.alias("place")).distinct().sort("place")
    sample = [r["place"] for r in drawn.collect()]  # about 8 for each bucket
    bucket = _bucket(F.col("place"), sorted({sample[len(sample) * k // n_buckets] for k in range(1, n_buckets)} if sample else ()))
    heads = keys.select(place.alias("place")).groupBy(bucket.alias("bucket")).agg(F.min("place").alias("head"))
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    heads = F.broadcast(heads.select(F.col("bucket").alias("_bucket"), "head", before.alias("before")))  # at most MOST_BUCKETS rows
    docs = docs.withColumn("place", place).withColumn("bucket", bucket)
    docs = docs.join(heads, docs["bucket"] == heads["_bucket"])
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("before").alias("at"), F.lit(True).alias("ghost"))
    docs = docs.select("doc_id", "text", "place", "times", F.inline(F.when(F.col("place") == F.col("head"), F.array(own, ghost)).otherwise(F.array(own))))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_buckets // 8))
    docs = docs.repartition(n, "at").withColumn("fingerprint", fingerprint(F.col("text")))
    docs = docs.withColumn("next", F.lead(F.struct("fingerprint", "text")).over(Window.partitionBy("at").orderBy("ghost", "place")))
    return docs.filter("NOT ghost").drop("place", "at", "ghost"), most


def _times(docs: DataFrame, n: str, most: int) -> DataFrame:
    """Every row as often as its column ``n`` says, ``most`` at most; many copies are dealt out in steps."""
    if most == 1:
        return docs.drop(n)
    steps = docs.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / _STEP))))
    if most > _STEP:
        steps = steps.repartition("edited_sha256", "_step")
    return steps.select(*[c for c in docs.columns if c != n], F.explode(F.array_repeat(F.lit(0), F.least(F.lit(_STEP), F.col(n) - _STEP * F.col("_step")).cast("int"))).alias("_copy")).drop("_copy")


#: Equal results are dealt out in steps of at most this many.
_STEP = 4096


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of ``docs`` (doc_id, text; other columns are not read).

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many of the next document's. Null text is empty; texts of any length are
    read whole. A table of one document is its own next one. Rows that share an id, or have none, are
    separate documents, in the order of their texts' digests; where they share the text too, all
    but one have themselves as the next. Empty input gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs, most = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    of_next = F.struct(F.col("next.text").alias("whole"), F.col("next.fingerprint").alias("next_fingerprint"), F.lit(1).cast("long").alias("copies"))
    of_self = F.struct(F.col("text").alias("whole"), F.col("fingerprint").alias("next_fingerprint"), (F.col("times") - 1).alias("copies"))
    docs = docs.select("doc_id", "text", "fingerprint", F.inline(F.when(F.col("times") > 1, F.array(of_next, of_self)).otherwise(F.array(of_next))))
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("whole", F.lit(1), cut))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint", "copies")
    docs = docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", "copies")
    docs = docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "copies")
    return _times(docs, "copies", most)


def _sql_fingerprint(text: str) -> str:
    blank = r"'\n[ \t\r]*\n'"
    sections = f"string_split_regex({text}, {blank})"
    paragraphs = lambda of, join: f"array_to_string(list_transform(string_split(s, chr(10)), lambda p: {of}), '{join}')"
    nodes = f"array_to_string(list_transform({sections}, lambda s: sha256({paragraphs('sha256(p)', '/')})), '|')"
    leaves = f"array_to_string(list_transform(regexp_extract_all(p, '(?s).{{1,{LEAF}}}'), lambda x: md5(x)[1:{_SHORT}]), '')"
    branches = f"array_to_string(list_transform({sections}, lambda s: {paragraphs(leaves, '/')}), '|')"
    return f"sha256(sha256({nodes}) || ':' || array_to_string(regexp_extract_all({text}, {blank}), '|')) || ':' || {branches}"


def _sql_likeness(a: str, b: str) -> str:
    x, y = (f"list_distinct(regexp_extract_all({m}[66:], '[0-9a-f]{{{_SHORT}}}'))" for m in (a, b))
    return f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


#: DuckDB SQL for the rows of op9.
SQL = f"""
WITH told AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest FROM documents),
ordered AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, digest) AS at FROM told),
paired AS (
  SELECT a.doc_id, a.text, b.text AS next, length(a.text) AS n_chars, length(a.text) // 3 AS cut
  FROM ordered a JOIN ordered b ON b.at = a.at % (SELECT count(*) FROM told) + 1),
edits AS (SELECT doc_id, n_chars, text, next, left(text, n_chars - cut) || left(next, cut) AS edited FROM paired),
marks AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_sql_fingerprint("text")} AS fingerprint, {_sql_fingerprint("edited")} AS edited_fingerprint, {_sql_fingerprint("next")} AS next_fingerprint FROM edits)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_sql_likeness("fingerprint", "edited_fingerprint")}::DOUBLE AS near_edited, {_sql_likeness("fingerprint", "next_fingerprint")}::DOUBLE AS near_next
FROM marks
"""
