"""Operator 7: exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, freed, join_skewed, remove_path, saved, shared_dir


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _digest(text_col: str) -> Column:
    return F.sha2(F.translate(_text(text_col), SPACE, "").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 of the text without white space, n_chars of the text itself."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("text_sha256"), F.char_length(_text(text_col)).alias("n_chars"))


class DigestIndex:
    """A table of digests, bucketed and sorted by them, that batches are appended to.

    A batch adds one row per distinct text: text_sha256, keep_id, keep_chars, alike (rows
    that tie with the one kept in id and length), group_size, fresh (whether the digest
    was new then, by sort-merge anti-join of the batch with the index). read() merges a
    digest's rows, bucket by bucket and without a shuffle: sizes add up, and of all
    batches the longest text, then the smallest doc_id (null last) stays. So an earlier
    winner may lose to a later, longer text; `fresh` tells what each batch brought.

    The table lies in `location`, by default a folder of spark.checkpoint.dir, which
    executors share. Opened with the same location and buckets it goes on in another
    session.
    """

    COLUMNS = "text_sha256 string, keep_id long, keep_chars int, alike long, group_size long, fresh boolean"

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, location: str | None = None) -> None:
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.location = location or shared_dir(spark)
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} ({self.COLUMNS}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.location}'")

    def rows(self) -> DataFrame:
        """Every batch's rows."""
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """text_sha256, keep_id, keep_chars, alike, group_size: a row per distinct text."""
        order = F.struct((-F.col("keep_chars")).alias("n"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"))
        # the row that wins is unique in its batch; equal winners of several batches add up
        each = self.rows().groupBy("text_sha256", "keep_id", "keep_chars").agg(F.sum("alike").alias("alike"), F.sum("group_size").alias("own"))
        best = each.groupBy("text_sha256").agg(F.min(F.struct(order.alias("o"), "alike")).alias("best"), F.sum("own").alias("group_size"))
        return best.select("text_sha256", F.col("best.o.id").alias("keep_id"), (-F.col("best.o.n")).alias("keep_chars"), F.col("best.alike").alias("alike"), "group_size")

    def append(self, batch: DataFrame) -> None:
        """batch: as digests() gives it."""
        each = batch.groupBy("text_sha256", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("n").alias("alike")))
        groups = each.groupBy("text_sha256").agg(best.alias("best"), F.sum("n").alias("group_size"))
        groups = groups.select("text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars"), F.col("best.alike").alias("alike"), "group_size")
        if not self.rows().isEmpty():
            groups = saved(groups)
            known = self.rows().filter("fresh").select("text_sha256").hint("merge")  # one row per digest
            new = groups.join(known, "text_sha256", "left_anti").withColumn("fresh", F.lit(True))
            rows = new.unionByName(groups.join(known, "text_sha256", "left_semi").withColumn("fresh", F.lit(False)))
        else:
            rows = groups.withColumn("fresh", F.lit(True))
        rows = rows.select(*[x.split()[0] for x in self.COLUMNS.split(", ")])
        rows.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").write.mode("append").insertInto(self.name)
        dropped(groups)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.location)


def label(batch: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of batch: doc_id, keep_id, group_size, kept, text_sha256, n_chars,
    alike: how many rows tie with it, if it is kept.

    Groups are hot by the rows of the batch, not by the index: the rows of hot ones meet
    a broadcast of at most 1000 groups, whatever the index holds.
    """
    own = batch.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("rows_here"))
    groups = index.read().join(own, "text_sha256")
    both = join_skewed(batch, groups, ["text_sha256"], "rows_here", max(batch.count(), 1))
    won = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return both.withColumn("kept", won)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds docs to the index and returns one row per document: doc_id, keep_id,
    group_size, kept, text_sha256.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; null
    counts as empty, and all empty texts form one group. The longest text, then the
    smallest doc_id stays; null ids lose ties. Of rows that tie in digest, id and length
    exactly one is kept. With an index, sizes and winners are those over all its batches.
    Without one a new one is made for these documents alone. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    batch = saved(digests(docs, id_col, text_col))
    own = index or DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    own.append(batch)
    freed(spark)
    marked = label(batch, own)
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    ties = (F.col("kept") & (F.col("alike") > 1))
    out = marked.filter(~ties).select(*names)
    # rows that tie and win are counted, not gathered: the first of each stays
    few = marked.filter(ties).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    few = few.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("kept", F.col("i") == 1)
    out = saved(out.unionByName(few.select(*names)))
    dropped(batch)
    if index is None:
        own.drop()
    return out


def kept(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all columns, of each group of equal texts: the longest
    text, then the smallest doc_id (null last), then the row that is least as JSON; of
    rows alike in all columns one stays.

    Null texts count as empty and stay once. Columns may have any names. Empty docs give
    no rows.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    index.append(digests(docs, id_col, text_col))
    freed(spark)
    # the row as one column: no name of a helper can clash with its own
    rows = docs.select(F.struct("*").alias("row"), _digest(text_col).alias("digest"), F.col(id_col).cast("long").alias("id"), F.char_length(_text(text_col)).alias("chars"))
    best = saved(index.read().select(F.col("text_sha256").alias("w_digest"), F.col("keep_id").alias("w_id"), F.col("keep_chars").alias("w_chars"), "alike"))
    index.drop()
    on = (F.col("digest") == F.col("w_digest")) & F.col("id").eqNullSafe(F.col("w_id")) & (F.col("chars") == F.col("w_chars"))
    out = rows.join(best.filter("alike = 1"), on, "left_semi").select("row")
    ties = best.filter("alike > 1")
    if not ties.isEmpty():  # rows that share id and length too
        one = rows.join(ties, on, "left_semi").groupBy("digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(one.select("row"))
    return out.select("row.*")
