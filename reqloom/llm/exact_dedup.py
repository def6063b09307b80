"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is first
reduced to its distinct digests (partial aggregation, so a digest that a third
of all rows share costs one row a task), which a sort-merge anti-join holds
against the index: the index side is read bucket by bucket, without a shuffle.
What is new is appended, with the batch's id. A batch that is run again, after a
lost driver or by mistake, finds its own digests by that id and gives the same
rows as before.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.common import delete_path, fresh_name, if_few, scratch_path, table, written

#: Buckets of a new index: at least BUCKETS, and one for each so many digests expected, up to MOST_BUCKETS.
BUCKETS, BUCKET_ROWS, MOST_BUCKETS = 16, 4_000_000, 16_384


def digest(text_col: str):
    """SHA-256 of the text as it is, in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Rows (digest, keep_id, group_size, batch): each digest once, with the id of the row that stays and the batch that brought it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, expected_rows: int = 0):
        """Opens the index at ``path``, or begins one there. ``buckets`` and ``expected_rows`` hold for a new one only."""
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        described = f"{self.path}_layout"
        layout = self._filesystem_path(described)
        if layout.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(layout):
            buckets = spark.read.parquet(described).first()["buckets"]
        else:
            buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, -(-expected_rows // BUCKET_ROWS)))
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(described)
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _filesystem_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def known(self, groups: DataFrame, batch: str) -> DataFrame:
        """(digest, keep_id, group_size, fresh) of the digests of ``groups`` that are here; ``fresh``: this batch brought them."""
        held = self.read().hint("merge").join(groups.select("digest"), "digest")
        return written(held.select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("fresh")), "known-digests")

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Appends the (digest, keep_id, group_size) rows of new digests and returns them."""
        fresh = written(groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id", "group_size"), "fresh-digests")
        fresh.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return fresh

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def delete(self) -> None:
        self.close()
        delete_path(self.spark, self.path)
        delete_path(self.spark, f"{self.path}_layout")


def _pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, doc_id, n): repeated rows of one document once."""
    return docs.select(digest(text_col).alias("digest"), F.col(id_col).cast("long").alias("doc_id")).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))


def _groups(pairs: DataFrame) -> DataFrame:
    """For each digest the largest id, its rows, and how many of these have that id."""
    times = F.max_by("n", F.coalesce("doc_id", F.lit(-(1 << 63))))
    return pairs.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), times.alias("times"))


def batch_id(pairs: DataFrame) -> str:
    """The same for the same rows, in any order: their number and a sum of their hashes."""
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("digest", "doc_id", "n").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h'] or 0}"


def _decided(pairs: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """(digest, keep_id, group_size, fresh, times) for each digest of the batch; new ones are in the index afterwards."""
    spark, groups = pairs.sparkSession, _groups(pairs)
    if index is None:
        groups = written(groups, "digest-groups")
        own = DigestIndex(spark, scratch_path(spark, "digest-index"), expected_rows=groups.count())
        own.add(groups, "first")  # all of them: the index was empty
        own.delete()
        return groups.withColumn("fresh", F.lit(True))
    groups, batch = written(groups, "digest-groups"), batch or batch_id(pairs)
    known = index.known(groups, batch)
    added = index.add(groups, batch).withColumn("fresh", F.lit(True))
    return known.unionByName(added).join(groups.select("digest", "times"), "digest")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Of equal texts the row with the largest doc_id stays; ``group_size`` counts
    all of them. With an ``index`` that has a text already, none of the batch's
    rows stays, and keep_id and group_size are the index's; new texts are added.
    ``batch`` names the batch in the index (by default its rows do), so that one
    run again gets the same rows.

    Null counts as empty text; very long texts count whole. Of rows repeated
    whole, one is kept. Null doc_ids stay only where a group has no other, once.
    Other columns aren't read. An empty table gives an empty one.
    """
    pairs = written(_pairs(docs, id_col, text_col), "digest-pairs")
    held = _decided(pairs, index, batch).select(F.col("digest").alias("of"), "keep_id", "group_size", "fresh")
    # both sides are the batch's own and are shuffled, so AQE can split a hot digest
    joined = pairs.join(held, pairs["digest"] == held["of"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("fresh")
    rows = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select("doc_id", "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps; columns stay as they are.

    Null counts as empty text, very long texts count whole, of rows repeated
    whole one stays, null ids stay only where a group has no other; an empty
    table gives an empty one, and a batch run again on its ``index`` the same rows.

    Only digests that occur more than once, or that the index had, are joined
    back. These are broadcast if they are few (BROADCAST_ROWS), so that texts
    aren't shuffled; else the join is a sort-merge join whose hot digests AQE splits.
    """
    pairs = written(_pairs(docs, id_col, text_col), "digest-pairs")
    held = _decided(pairs, index, batch)
    mine, keep, whole, number, tag = (fresh_name(docs.columns, x) for x in ("of_digest", "row_keep", "row_whole", "row_number", "row_digest"))
    decided = held.where("group_size > 1 or not fresh").select(F.col("digest").alias(mine), F.col("keep_id").alias(keep), (F.col("fresh") & (F.col("times") == 1)).alias(whole), F.col("fresh").alias(number))
    decided = written(decided, "decided-digests")
    tagged, row_id = docs.withColumn(tag, digest(text_col)), F.col(id_col).cast("long")
    joined = tagged.join(if_few(decided.select(mine, keep, whole)), F.col(tag) == F.col(mine), "left")
    plain = joined.where(F.col(mine).isNull() | (F.col(whole) & row_id.eqNullSafe(F.col(keep)))).select(*(joined[f"`{c}`"] for c in docs.columns))
    repeated = written(decided.where(F.col(number) & ~F.col(whole)).select(mine, keep), "repeated-digests")
    if repeated.isEmpty():
        return plain
    again = tagged.join(if_few(repeated), (F.col(tag) == F.col(mine)) & row_id.eqNullSafe(F.col(keep)), "left_semi")
    once = again.withColumn(number, F.row_number().over(Window.partitionBy(tag).orderBy(F.lit(1)))).where(F.col(number) == 1)
    return plain.unionByName(once.drop(number, tag))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of the whole ``documents`` table, through a new index."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t, doc_id) AS copy
  FROM d
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND copy = 1) AS kept, sha256(t) AS text_sha256
FROM r
"""
