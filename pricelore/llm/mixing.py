"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is a number of words. Whole epochs of the source come first; for what is left, every document has an
exponential key divided by its quality weight (Efraimidis and Spirakis), documents are taken in the order of their keys, and
the sum of sizes along that order is held against the budget. The order's sums are found through a histogram of the keys: only
documents in the one bucket of each source in which the budget runs out are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
#: Buckets of a source's keys. The one that is sorted holds about a source's rows over this number.
BUCKETS = 16_384


def size_of(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_of(key: Column) -> Column:
    """A number strictly between 0 and 1 from the MD5 of a key; reruns agree on it."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), total_share: float = 1.0, most: float = MOST_EPOCHS) -> DataFrame:
    """Of one row a source (source, source_size): its target in words.

    Sources in code point order, null last, get the weights in turn and share total_share of all words. A target stops at
    `most` times its source's size; what is over goes to the others by weight, until none is above. With the sources ordered
    by the ratio of that limit to their weight, a first part of them stops at its limits and one level times the weight
    holds for all others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__i", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.lit(float(most)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__ratio", "__i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(total_share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    ranked = ranked.withColumn("__level", level)
    fits = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__i", "__level"))).over(everything)
    ranked = ranked.withColumn("__fit", fits)
    capped = F.col("__fit").isNull() | (F.struct("__ratio", "__i") < F.struct(F.col("__fit.__ratio").alias("__ratio"), F.col("__fit.__i").alias("__i")))
    return ranked.select("source", "source_size", F.when(capped, F.col("__cap")).otherwise(F.col("__fit.__level") * F.col("__w")).alias("target"))


#: What mix() returns beside the given columns.
MADE = ("size", "source_size", "target", "taken", "copies")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), total_share: float = 1.0, most: int = MOST_EPOCHS, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """df's rows with size, source_size, target (of the row's source), taken: the words that the mix takes of the row,
    repeats counted, and copies: how often it takes the row. Columns of those names are replaced.

    `weight` is a column, the document's quality (default: 1); null or not positive counts as the smallest
    weight. A row is taken whole: the epochs that its source's target holds, and once more if the middle of its words
    comes before the rest of the target runs out in the order of keys. So a source misses its target by half of one row's
    words at most. A row without words, null or empty, takes part with size 0. A null id has the key of an empty string; rows of
    equal ids are ordered by a digest of their texts, and of equal texts it does not matter which. A source of which no row has words
    has the target 0; an empty table gives no rows. `size` and `tie` stand in for the words and the digest of the text, where the
    caller has them already.
    """
    given = [c for c in df.columns if c not in MADE]
    names = [f"__c{i}" for i in range(len(given))]
    quality = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    key = -F.ln(unit_of(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))) / quality
    size = size_of(F.col(f"`{text_col}`")) if size is None else size
    tie = F.coalesce(F.md5(F.col(f"`{text_col}`").cast("binary")), F.lit("")) if tie is None else tie
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)], F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__s"), key.alias("__key"), bucket.alias("__bucket"), size.alias("__size"), tie.alias("__tie"))
    # One row for each source and bucket: no more than BUCKETS a source, whatever the number of documents.
    cells = rows.groupBy(F.col("__s").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("words"))
    cells = stored(cells, "mix-cells")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.sum("words").over(upto)).join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    # The bucket in which the rest runs out: all before it is taken, none after it.
    edge = cells.filter(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    plan = sources.join(edge.select(F.col("source").alias("s"), "edge"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.coalesce(F.col("edge.bucket"), F.lit(BUCKETS)).alias("__edge"), F.coalesce(F.col("edge.before"), F.lit(0)).alias("__before"))
    # Read back from storage the plan's size is known, so it is broadcast only if it is under the session's limit.
    rows = rows.join(stored(plan, "mix-plan"), F.col("__s").eqNullSafe(F.col("__source")))
    whole = rows.filter(F.col("__bucket") != F.col("__edge")).withColumn("__more", (F.col("__bucket") < F.col("__edge")).cast("int"))
    order = Window.partitionBy("__s").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.filter(F.col("__bucket") == F.col("__edge")).withColumn("__more", (F.col("__before") + F.coalesce(F.sum("__size").over(order), F.lit(0)) + F.col("__size") / 2 < F.col("__rest")).cast("int"))
    copies = F.col("__epochs") + F.col("__more")
    made = (F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * copies).alias("taken"), copies.cast("int").alias("copies"))
    return whole.unionByName(edges).select(*[F.col(n).alias(c) for c, n in zip(given, names)], *made)


ORACLE = r"""
WITH d AS (
 SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  -ln((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS k, coalesce(md5(text), '') AS tie
 FROM documents),
q AS (SELECT doc_id AS i, max(quality) AS quality FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1),
w AS (SELECT d.*, k / (CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END) AS key FROM d LEFT JOIN q ON d.doc_id = q.i),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS INT) AS i FROM s),
c AS (SELECT *, CAST(i % 3 + 1 AS DOUBLE) AS wt, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (
 SELECT *, cap / wt AS ratio,
  (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
 FROM c),
f AS (SELECT ratio AS fr, i AS fi, lev AS fl FROM l WHERE lev <= ratio ORDER BY ratio, i LIMIT 1),
t AS (
 SELECT source, source_size, CASE WHEN f.fr IS NULL OR (ratio, i) < (fr, fi) THEN cap ELSE fl * wt END AS target
 FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (
 SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY w.source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM w JOIN e ON w.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN before + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS taken,
 CAST(epochs + CASE WHEN before + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END AS INT) AS copies
FROM p
"""
