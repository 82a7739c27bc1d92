"""Exact dedup against a persistent digest index, bucketed and sorted by hash [native]."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keyed, shared_dir, written


def digest(text: Column) -> Column:
    """SHA-256 of the whole UTF-8 text, null counting as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


class DigestIndex:
    """A table (digest, keep_id, group_size) of every text seen, written in ``buckets`` buckets by digest, each file sorted by it.

    It lives at ``path`` and outlasts its session: what stands there decides
    whether it exists, and a new session registers it again with the buckets it was
    written in. A batch is reduced to one row per digest first (largest id stays), so its hot
    texts are combined before any shuffle. Then it meets the index in a
    sort-merge anti-join that reads the index bucket by bucket, without a
    shuffle of it, and what is new is appended. The number of buckets is fixed when
    the index is made: choose it for the size the index will have.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or f"{shared_dir(spark)}/{self.name}").rstrip("/")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        try:
            self.buckets = self.spark.read.schema("buckets long").json(f"{self.path}-buckets").first()["buckets"]
        except AnalysisException as e:  # there is none yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(f"{self.path}-buckets")
        self.register()

    def register(self) -> None:
        """Name the table in this session's catalog, with its buckets, over whatever stands at the path."""
        columns = "digest STRING, keep_id BIGINT, group_size BIGINT"
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the name out of the catalog; the index stays at its path."""
        self.spark.sql(f"DROP TABLE {self.name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Append the texts of a batch (doc_id, digest) that the index lacks; returns the rows appended."""
        # written, or the optimizer would put the anti-join before the groupBy, and all copies of a hot text into one task
        batch = written(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        new = batch.repartition(self.buckets, "digest").hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new = written(new, "digest-new")  # the index is read in full before it grows
        new.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        return new

    def known(self, batch: DataFrame) -> DataFrame:
        """(digest, keep_id) of the digests of a batch, from the index, read bucket by bucket."""
        return batch.select("digest").distinct().repartition(self.buckets, "digest").hint("merge").join(self.table().select("digest", "keep_id").hint("merge"), "digest")


def dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs`` (doc_id, text; other columns are not read).

    Null text equals empty text. Of equal texts the largest id stays; a null id
    is smaller than any. Rows that repeat the kept id are all ``kept``: they are the
    same document. The rows come to the index in ``batches``, larger ids first, so
    that what a batch finds in the index is larger than its own. If the index had rows before,
    keep_id may be an id of theirs; group_size counts the rows of ``docs``. Texts of any length are
    read whole. Empty input gives an empty result.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    own = index or DigestIndex(docs.sparkSession)
    cuts = rows.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    above = None
    for cut in sorted(set(cuts or []), reverse=True):
        part = F.col("doc_id") > cut
        own.add(rows.filter(part if above is None else part & (F.col("doc_id") <= above)))
        above = cut
    own.add(rows if above is None else rows.filter((F.col("doc_id") <= above) | F.col("doc_id").isNull()))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    # Written, so that both sides of the next join shuffle, and adaptive execution can split a digest that holds a large part of all rows.
    known = written(own.known(rows).join(sizes, "digest"), "digests-known")
    if index is None:
        own.forget()
    joined = rows.hint("merge").join(known.hint("merge"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each text of ``docs``: that of the largest id, a null id being smaller than any.

    The decision is the row's, by id and text; of rows that share both, one stays.
    Other columns are kept as they are, whatever their names.
    """
    row = fresh(docs, "_row")
    docs = keyed(docs, row, "exact-documents")
    found = docs.select(digest(F.col("text")).alias("digest"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), (-F.col(row)).alias("row")).alias("last"))
    best = written(found.groupBy("digest").agg(F.max("last").alias("last")).select("digest", "last.doc_id", (-F.col("last.row")).alias(row)), "exact-best")
    index = DigestIndex(docs.sparkSession)
    new = index.add(best.select("doc_id", "digest"))
    index.forget()
    stays = best.join(new.select("digest"), "digest").select(row)
    return docs.join(stays, row, "left_semi").drop(row)


#: DuckDB SQL for the rows of op5.
SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
