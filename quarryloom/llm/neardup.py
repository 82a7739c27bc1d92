"""Near-duplicate documents by SetSketch registers, banded, estimated jointly, then verified on full sets.

A document is its set of distinct word shingles. Register i of its sketch is
the exponentially spaced, truncated minimum of the set's i-th hash:
floor(1 - log_B(x)) with x the least of exponential values, clipped to
[0, TOP]. Registers of a union are maxima, so sketches merge; two sets share a
register with a chance of at least their similarity, so bands of registers
meet as minhash does. With 24 bands of 5, a pair of similarity 0.85 shares no
band, and is missed, with a chance of 8e-7, one of 0.8 with 7e-5, one of 0.9 with
5e-10; in a group, only if the links of its other members don't join the two.

Documents with equal sets are one class before anything is paired. In every
bucket the members meet its smallest node only; verified links give components.
Buckets whose members still lie in different components remain. In one of at
most ``SMALL`` members these meet each other. Larger ones are joined to groups,
and every member becomes its difference D from the group's majority set C (the
shingles that over half of the group have). |x xor y| = |Dx| + |Dy| - 2 |Dx and Dy|,
so with slack s = |D| - k |x|, k = (1 - J) / (1 + J), a pair is linked exactly if
s(x) + s(y) <= 2 |Dx and Dy|. Pairs with s(x) + s(y) <= 0 are linked in any case,
and all of them also to the member of least slack, so that a star stands for
them; any other pair shares a difference, and one among the rarest of each
(prefix filtering). Of the pairs that share a band, no link is lost in either way.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, keyed, returning_memory, slices, written
from .components import components

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE = 1.02
TOP = (1 << 15) - 1
#: A pair whose estimate lies this far below the threshold is not verified: 7 standard errors of the estimate.
SLACK = 0.25
#: Members of different components meet each other in buckets of up to this many; larger ones go by differences.
SMALL = 8
#: Hashes of words that a Python worker keeps, for the length of a task.
MOST_WORDS = 200_000
#: A group of more members than this is dealt out in pieces of about this many, so that no join has it in one task.
PIECE = 1024
#: What only large groups have is laid out this many times while members learn how many pieces their group has.
DEALS = 256
_MULTIPLY = (np.random.default_rng(20240229).integers(1, 1 << 63, REGISTERS, np.uint64) << np.uint64(1)) | np.uint64(1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[4]
    x = (x ^ (x >> np.uint64(33))) * _ODD[5]
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; fewer words are one shingle, no word is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total * _ODD[0] + h[k : len(h) - n + 1 + k] * _ODD[1 + k % 3])
    return np.unique(total)


def registers(of: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(of), 2048):
        least = np.minimum(least, (of[None, at : at + 2048] * _MULTIPLY[:, None]).min(1))
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2**-40))
    # x is about 1 / size; the offset puts sets of one element near register 1500
    return np.clip(np.floor(1500 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.int16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, other bands' keys being different."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[2]
    for column in sketch.reshape(BANDS, ROWS).T:
        key = _mixed(key * _ODD[0] + column.astype(np.uint64))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (by row), by maximum likelihood from how many registers are larger, smaller and equal, given the sets' sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    up, down = (a > b).sum(1), (a < b).sum(1)
    best, best_j = np.full(len(a), -np.inf), np.zeros(len(a))
    chance = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    for j in np.linspace(0, 1, 101):
        p, q = chance(np.maximum(u - v * j, 0)), chance(np.maximum(v - u * j, 0))
        like = up * np.log(p) + down * np.log(q) + (a.shape[1] - up - down) * np.log(np.clip(1 - p - q, 1e-12, 1))
        better = (like > best) & (j <= np.minimum(u / v, v / u) + 1e-9)
        best, best_j = np.where(better, like, best), np.where(better, j, best_j)
    return best_j


def sketched(docs: DataFrame, size: int = 3) -> DataFrame:
    """(row, doc_id, n, d1, d2, sketch, keys) of ``docs`` (row, doc_id, text): set size, a 128-bit digest of the set, its registers and band keys."""
    names = ["row", "doc_id", "n", "d1", "d2", "sketch", "keys"]

    def run(batches):
        for b in batches:
            for part in slices(b, 2):
                n, d1, d2, sketches, keys = [], [], [], [], []
                for t in part.column(2).to_pylist():
                    s = shingles(t, size)
                    n.append(len(s))
                    d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(_mixed(s ^ _ODD[3]).sum(dtype=np.uint64).astype(np.int64)))
                    sketch = registers(s) if len(s) else None
                    sketches.append(None if sketch is None else sketch.tobytes())
                    keys.append([] if sketch is None else band_keys(sketch))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)
        _words().clear()

    return docs.select("row", "doc_id", "text").mapInArrow(returning_memory(run), "row long, doc_id long, n long, d1 long, d2 long, sketch binary, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets are similar enough: sizes, then the joint estimate, then the full sets."""
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def likely(batches):
        for b in batches:
            t = {k: b.column(b.schema.get_field_index(k)) for k in ("a", "b", "n_a", "n_b", "s_a", "s_b")}
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t[k].to_pylist()), np.int16).reshape(-1, REGISTERS) for k in ("s_a", "s_b"))
            hold = estimate(x, y, *(t[k].to_numpy(zero_copy_only=False).astype(float) for k in ("n_a", "n_b"))) >= percent / 100 - SLACK
            yield pa.RecordBatch.from_arrays([t["a"].filter(pa.array(hold)), t["b"].filter(pa.array(hold))], ["a", "b"])

    near = written(near.mapInArrow(returning_memory(likely), "a long, b long"), "near-likely")
    side = lambda c, x: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(x))
    both = F.size(F.array_intersect("x", "y"))  # row by row in the JVM: no batch of full sets in memory
    alike = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    links = written(near.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(alike).select("a", "b"), "near-links")
    discard(near)
    return links


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): the full sets of the ``needed`` documents, so that all texts are dealt out at most once."""

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 256):
                got = [shingles(t, size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "shingles"])
        _words().clear()

    return written(docs.join(needed, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(returning_memory(run), "doc_id long, shingles array<long>"), "near-sets")


def _pieces(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, group, piece) for every document of ``groups`` (doc_id, group), and (group, members, pieces) for every group."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    sizes = written(sizes.withColumn("pieces", F.ceil(F.col("members") / PIECE)), "near-group-sizes")
    large = sizes.filter("pieces > 1").select("group", "pieces", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = groups.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)).cast("int")).join(large, ["group", "deal"], "left")
    piece = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.coalesce("pieces", F.lit(1)))
    return dealt.select("doc_id", "group", piece.alias("piece")), sizes


def _per_piece(of_groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row of ``of_groups`` (group, ...) for every piece of its group."""
    return of_groups.join(sizes.select("group", "pieces"), "group").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")


def _differences(sets: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, piece, doc_id, n, d): for every document of ``groups`` (doc_id, group) its set's size and what is in its set or in the group's majority set, but not in both; and the groups' sizes."""
    dealt, sizes = _pieces(groups)
    full = written(sets.join(dealt, "doc_id"), "near-group-sets")
    counts = full.select("group", F.explode("shingles").alias("shingle")).groupBy("group", "shingle").agg(F.count("*").alias("has")).filter("has > 1")
    # over half of the members have each: a majority set is no larger than twice the mean set
    centers = counts.join(sizes, "group").filter("2 * has > members").groupBy("group").agg(F.collect_list("shingle").alias("center"))

    def less(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                t = {k: part.column(part.schema.get_field_index(k)) for k in ("group", "piece", "doc_id", "shingles", "center")}
                own = [x.values.to_numpy() for x in t["shingles"]]
                d = [np.setxor1d(x, c.values.to_numpy(), assume_unique=True) if c.is_valid else x for x, c in zip(own, t["center"], strict=True)]
                yield pa.RecordBatch.from_arrays([t["group"], t["piece"], t["doc_id"], pa.array([len(x) for x in own], pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["group", "piece", "doc_id", "n", "d"])

    found = full.join(_per_piece(centers, sizes), ["group", "piece"], "left").mapInArrow(returning_memory(less), "group long, piece long, doc_id long, n long, d array<long>")
    found = written(found, "near-differences")
    discard(full)
    return found, sizes


def _by_difference(buckets: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large ``buckets`` (key, doc_id, center): links that are certain, and candidate pairs, both (a, b); and the table that the latter come from.

    Slack is kept in whole numbers, as (100 + percent) |D| - (100 - percent) n.
    """
    groups = components(buckets.filter("doc_id != center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")))
    differences, sizes = _differences(sets, groups.select(F.col("id").alias("doc_id"), F.col("component").alias("group")))
    found = differences.withColumns({"n_d": F.size("d"), "slack": (100 + percent) * F.size("d") - (100 - percent) * F.col("n")})
    low = found.groupBy("group").agg(F.min(F.struct("slack", "doc_id")).alias("low"))
    found = found.join(_per_piece(low, sizes), ["group", "piece"])
    certain = written(found.filter("slack + low.slack <= 0 AND doc_id != low.doc_id").select(F.col("low.doc_id").alias("a"), F.col("doc_id").alias("b")), "near-certain")
    labels = components(links.unionByName(certain))

    each = found.select("group", "doc_id", "n", "n_d", "slack", F.col("low.slack").alias("low"), F.explode("d").alias("e"))
    shared = each.groupBy("group", "e").agg(F.count("*").alias("has")).filter("has > 1")
    by_doc = Window.partitionBy("doc_id")
    # a difference that no other member has stands before all others and need not be kept
    at = F.col("n_d") - F.count("*").over(by_doc) + F.row_number().over(by_doc.orderBy("has", "e")) - 1
    of_least = (F.col("slack") + F.col("low")) / (2 * (100 + percent))
    of_size = (percent * F.col("slack") - (100 - percent) * 100 * F.col("n")) / (percent * (100 + percent))
    posts = each.join(shared, ["group", "e"]).withColumn("left", F.col("n_d") - at)
    posts = posts.filter(F.col("left") >= F.greatest(F.lit(1), F.ceil(of_least), F.ceil(of_size)))
    posts = posts.join(labels, posts["doc_id"] == labels["id"], "left").select("group", "e", "doc_id", "n", "slack", "left", F.coalesce("component", "doc_id").alias("component"))
    kept = posts = written(posts, "near-posts")
    discard(differences)
    split = posts.groupBy("group", "e").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first < last").select("group", "e")
    posts = posts.join(split, ["group", "e"], "left_semi")
    x, y = posts.alias("x"), posts.alias("y")
    meet = (F.col("x.group") == F.col("y.group")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
    alike = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (2 * (100 + percent) * F.least("x.left", "y.left") >= F.col("x.slack") + F.col("y.slack"))
    return certain, x.join(y, meet & alike).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")), kept


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (row, doc_id, text), a written table: (row, doc_id, n, d1, d2) of every row, and for every distinct non-empty set (n, d1, d2) its component, the smallest id in that and the row which stays for it.

    Sets are nodes, named by the key of a row that has them, so that rows which
    share an id, or have none, are apart.
    """
    sketches = written(sketched(docs, size), "near-sketches")
    some = sketches.filter("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = written(some.groupBy("n", "d1", "d2").agg(F.min("row").alias("class"), best.alias("best")), "near-classes")
    nodes = some.join(classes.select(F.col("class").alias("row")), "row", "left_semi")
    nodes = written(nodes.select(F.col("row").alias("doc_id"), "n", "sketch", "keys"), "near-nodes")

    members = nodes.select(F.explode("keys").alias("key"), "doc_id")
    shared = members.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    members = written(members.join(shared, "key"), "near-members")
    pairs = members.filter("doc_id != center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    sets = _sets(docs.select(F.col("row").alias("doc_id"), "text"), members.select("doc_id").distinct(), size)
    links = _verified(pairs, sets, nodes, percent)

    labels = components(links)
    of = members.join(labels, members["doc_id"] == labels["id"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"), F.min("doc_id").alias("center")).filter("low < high").drop("low", "high")
    split_members = of = written(of.join(split, "key"), "near-split")
    small, large = of.filter(F.col("rows") <= SMALL), of.filter(F.col("rows") > SMALL)
    x, y = small.alias("x"), small.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")))
    cross = cross.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    certain, others, posts = _by_difference(large.select("key", "doc_id", "center"), links, sets, percent)
    cross = cross.unionByName(others).distinct().join(pairs, ["a", "b"], "left_anti")
    more = certain.unionByName(_verified(written(cross, "near-cross"), sets, nodes, percent))

    labels = components(links.unionByName(more))
    of = classes.join(labels, classes["class"] == labels["id"], "left").select("n", "d1", "d2", "best", F.coalesce("component", "class").alias("component"))
    lows = of.groupBy("component").agg(F.min("best").alias("best"))
    of = of.drop("best").join(lows, "component").select("n", "d1", "d2", "component", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("stays"))
    of, rows = written(of, "near-components"), written(sketches.select("row", "doc_id", "n", "d1", "d2"), "near-rows")
    discard(sketches, classes, nodes, members, sets, split_members, posts)
    return rows, of


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text; other columns are not read).

    Sets of distinct shingles of ``size`` words are linked from a similarity of
    ``percent`` hundredths on. component_id is the smallest id reachable by
    links, kept says whether that is the row's own. A null or empty text, or one without words, has 0
    shingles and is linked with nothing. Rows that share an id, or have none, are
    separate documents, each linked by its own text; a null id is larger than any other, so
    that component_id is null only where no row reachable has an id. Texts of any length are read
    whole. Empty input gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, of = _classes(keyed(docs, "row", "near-documents"), size, percent)
    found = rows.filter("n > 0").join(of.select("n", "d1", "d2", "component_id"), ["n", "d1", "d2"])
    found = found.select("doc_id", "n", "component_id").unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id (a null id last), and every row without words.

    Rows are judged one by one, by their own texts: those that share an id, or
    have none, are separate documents. Other columns are kept as they are, whatever their names.
    """
    row = fresh(docs, "_row")
    docs = keyed(docs, row, "near-documents")
    rows, of = _classes(docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, percent)
    stays = of.select(F.col("stays").alias(row)).distinct().unionByName(rows.filter("n = 0").select(F.col("row").alias(row)))
    return docs.join(stays, row, "left_semi").drop(row)


#: DuckDB SQL for the rows of op4, by comparing all documents that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM rows x JOIN rows y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN sides ON a = id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON id = doc_id
"""
