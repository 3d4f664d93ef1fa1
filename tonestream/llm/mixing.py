"""Operator 3: mixing sources to target weights by systematic sampling, native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Fixed value: weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
CELL = ["source", "digits", "head", "salt"]


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> the same and target.

    Water filling: with sources in the order of cap / weight, those before the water
    level get their cap and the others share what is left by weight, in closed form. One
    row per source stands in these windows, not one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("at", F.col("most") / F.col("w"))
    by = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("at") <= F.col("level"), F.col("most")).otherwise(F.col("level") * F.col("w")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) for each source, from its name and the seed."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, *, seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source expects target / source_size copies. Documents of a
    source stand in the order of their size class, then of a digest of their id; the
    expected copies are summed along that order, shifted by one random offset of the
    source, and a document is emitted once per whole number that its own part of the sum
    crosses. Neighbours are alike in size, so the words taken stay near the target.

    The prefix sums never gather a source: rows are numbered within cells of source, size
    class and 256 digest prefixes, and the cells' counts are summed per source. Size
    classes are bounded by the longest text, so a source has a bounded number of cells.

    Null and empty texts have size 0 and take nothing. A null source is a source, last in
    order. A source of size 0 has target 0. Rows repeated with one doc_id are sampled each;
    rows that tie in everything are interchangeable. An empty table gives no rows. Other
    columns are ignored. A `row_key` stands behind the id in the order and in the rows.
    """
    extra = [] if row_key is None else [row_key.alias("row_key")]
    size = F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    ident = docs[id_col].cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"))
    slim = saved(docs.select(ident.alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size"), key.alias("key"), *extra))
    digits = F.length(F.bin("size"))
    rows = slim.withColumns({"digits": digits, "salt": F.substring("key", 1, 2)}).withColumn("head", F.expr("shiftright(size, greatest(digits - 4, 0))"))

    cells = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights)
    before = Window.partitionBy("source").orderBy(*CELL[1:]).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("words", "n")
    g = goal.withColumnRenamed("source", "g_source")
    cells = cells.join(g, cells["source"].eqNullSafe(g["g_source"])).drop("g_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cells = cells.withColumns({"rate": rate, "shift": offset(F.col("source"), seed)})

    here = rows.withColumn("i", F.row_number().over(Window.partitionBy(*CELL).orderBy("key", "doc_id", *(["row_key"] if extra else []))).cast("long"))
    c = cells.select(*[F.col(x).alias(f"c_{x}") for x in CELL], "before", "rate", "shift", "source_size", "target")
    both = here.join(c, F.expr(" and ".join(f"{x} <=> c_{x}" for x in CELL)))
    i = F.col("before") + F.col("i")
    crossed = F.floor(F.col("shift") + i * F.col("rate")) - F.floor(F.col("shift") + (i - 1) * F.col("rate"))
    copies = F.least(crossed, F.lit(math.ceil(cap))).cast("long")  # a whole number crosses no more
    return both.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row_key"] if extra else []))


def emitted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it.

    Rows that tie in id, source and text share the group's copies exactly; which of them
    gets one more is by their order as JSON. Texts without words take nothing. Columns
    may have any names. An empty table gives no rows.
    """
    ident, source = F.col(id_col).cast("long"), F.col(source_col).cast("string")
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, row_key=digest, **options)
    taken = taken.filter("size > 0").groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("row_key").alias("t_digest")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = saved(taken.filter("copies > 0"))
    # the row as one column: no name of a helper can clash with its own
    own = docs.select(F.struct("*").alias("row"), ident.alias("id"), source.alias("source"), digest.alias("digest"))
    on = F.col("id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("digest") == F.col("t_digest"))
    plain = own.join(taken.filter("rows = 1"), on).select("row", "copies")
    ties = taken.filter("rows > 1")
    if not ties.isEmpty():
        # rows alike are counted first: each kind of row gets its share of the copies
        kinds = own.join(ties, on).groupBy("id", "source", "digest", F.to_json("row").alias("json")).agg(F.min_by("row", F.lit(0)).alias("row"), F.count(F.lit(1)).alias("alike"), F.first("copies").alias("copies"), F.first("rows").alias("rows"))
        order = Window.partitionBy("id", "source", "digest").orderBy("json")
        end = F.sum("alike").over(order.rowsBetween(Window.unboundedPreceding, 0))
        more = F.col("copies") % F.col("rows")
        extra = F.least(more, end) - F.least(more, end - F.col("alike"))
        plain = plain.unionByName(kinds.select("row", (F.expr("copies div rows") * F.col("alike") + extra).alias("copies")))
    return plain.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
