"""Packing by shortest-pack-first over the length histogram.

Documents become token ids and an end id, and are cut at every ``max_len`` ids.
The histogram of piece lengths (at most ``max_len`` bins, whatever the input)
is packed on the driver: lengths longest first, each into the pattern with the
most room left, with counts of patterns rather than packs. Pieces then find
their place by their rank among the pieces of their length. A rank comes from
hashed buckets of bounded size, so that no length, however common, is sorted in one task.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import returning_memory, slices, written
from .tokens import default_path, ids_of

BUCKET_ROWS = 4096


def pieces(docs: DataFrame, max_len: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the cut token ids of every whole text; null text is empty."""
    path = tokenizer_path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def cut(batches):
        ids = ids_of(path)
        for b in batches:
            for part in slices(b, 1):
                rows = [[] for _ in range(5 + keep_ids)]
                for doc_id, got in zip(part.column(0).to_pylist(), ids.many([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    got = memoryview(got + end)
                    n = len(got) // 4
                    for start in range(0, n, max_len):
                        piece = got[4 * start : 4 * (start + max_len)]
                        for column, v in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, *[bytes(piece)] * keep_ids), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(returning_memory(cut), schema)


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[list[int], int]]:
    """(lengths, how many packs) of every pattern: places lengths longest first, each into the shortest packs that exist.

    Every step uses up a group of packs or ends a length, so there are at most
    twice as many patterns as lengths.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []  # rooms that have packs, ascending

    def put(room: int, count: int, pack: list[int]) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, pack = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop()
                used = min(count, left)
                if count > used:
                    put(room, count - used, pack)
            else:
                room, used, pack = max_len, left, []
            put(room - length, used, [*pack, length])
            left -= used
    return [(pack, count) for room in rooms for count, pack in by_room[room]]


def places(found: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For ranks of each length: runs (length, first rank, pieces per pack, first sequence, offset), sorted."""
    runs, ranks, sequence = [], {}, 0
    for pack, count in found:
        at = 0
        for length in dict.fromkeys(pack):  # equal lengths stand together
            per = pack.count(length)
            runs.append((length, ranks.get(length, 0), per, sequence, at))
            ranks[length] = ranks.get(length, 0) + per * count
            at += per * length
        sequence += count
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "sequence", "offset"), columns, strict=True))


def pack(cut: DataFrame, max_len: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...); empty input gives an empty result."""
    spark = cut.sparkSession
    cut = written(cut, "pack-pieces")
    histogram = cut.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # at most max_len rows
    runs = spark.sparkContext.broadcast(places(patterns(counts, max_len)))
    n_buckets = spark.createDataFrame([(k, -(-v // BUCKET_ROWS)) for k, v in counts.items()], "length long, buckets long")
    cut = cut.join(F.broadcast(n_buckets), "length").withColumn("order", F.xxhash64("doc_id", "start", "ids_crc32"))
    cut = cut.withColumn("bucket", F.pmod("order", "buckets")).drop("buckets")
    sums = cut.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sums.select("length", "bucket", before.alias("first"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("order", "doc_id", "start")
    ranked = cut.withColumn("rank", F.row_number().over(in_bucket) - 1).join(firsts, ["length", "bucket"])
    kept = [c for c in cut.columns if c not in ("order", "bucket")]
    ranked = ranked.select(*kept, (F.col("rank") + F.col("first")).cast("long").alias("rank"))

    def place(batches):
        r = runs.value
        key = (r["length"] << 48) + r["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, (length << 48) + rank, "right") - 1
            row, nth = np.divmod(rank - r["rank"][k], r["per"][k])
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(r["sequence"][k] + row), pa.array(r["offset"][k] + nth * length)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, max_len: int = 2048, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Reads doc_id and text alone. A null or empty text is its end id. Repeated ids
    are packed as often as they stand there. Texts of any length are read whole, one at a time. Empty input
    gives an empty result.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack(pieces(docs, max_len, tokenizer_path, end_id), max_len).select(*names)
