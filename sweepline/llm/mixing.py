"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source size times in the mix. Within a source the expected
copies are summed up in order of (size, doc_id); one offset for the source, drawn from its name and a seed, is
added, and a document is emitted once for each whole number that its stretch of the sum crosses. As every document of a
source has the same expectation, the sum before a document is its rank times the rate: ranks come from places
in sorted range partitions plus the counts of the partitions before, so no source meets in one task. Rows travel once, with all their
columns for the mix, without texts for the plan; rows equal in all of the order may stand in any partition, so a row repeated many times is spread too.

Targets share the size of all documents by weight; a target stops at ``most`` times its source's size and what it
can't take is shared again by weight among the rest: sources sorted by cap / weight stop as long as their
cap is under their share of what is left.

Nulls: a null text has size 0; documents of size 0 take 0 words. A null source is a source of its own, last in
order; a null ``doc_id`` sorts first. Repeated rows are documents of their own; those that share source, size and id go by
a hash of their text. Own columns get names that the table doesn't have. Only ``doc_id``, ``text`` and
``source`` are read by ``mix_plan``. An empty table gives an empty result. Targets are worked out in one task, over a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, shuffle_partitions, table

#: Rows (of a source in a range partition) up to which the plan is sent to every task; beyond it, it is joined by a shuffle.
SENT_ROWS = 200_000


def size_of(text: str = "text") -> Column:
    """Words of a text: runs of characters that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target, rate); one row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1).cast("long")
    cap = most * F.col("source_size")
    capped = sizes.withColumn("weight", weight).withColumn("cap", cap)
    every = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = capped.withColumn("full", F.col("cap") * weight_left <= left * F.col("weight"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    share = rest.cast("double") * F.col("weight") / rest_weight
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    out = full.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.withColumn("rate", F.least(rate, F.lit(float(most)))).select("source", "source_size", "weight", "target", "rate")


def source_offset(seed: int, source: str = "source") -> Column:
    """A number in [0, 1) from the source's name: 32 bits of its md5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _planned(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, with_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` (without the text, if it isn't wanted) with five more columns, and their names: id, size, source size, target and copies."""
    spark = docs.sparkSession
    id_, source_, size_, hash_, tie, part, place = free_names(docs, "id", "source_name", "size", "text_hash", "tie", "part", "place")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), source_: F.col("source").cast("string"), size_: size_of(), hash_: F.xxhash64("text")})
    keyed = keyed if with_text else keyed.drop("text")
    order = [F.col(source_).asc_nulls_last(), F.col(size_).asc(), F.col(id_).asc_nulls_first(), F.col(hash_), F.col(tie)]
    ranged = keyed.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # The low 33 bits of the id are the row's place in its partition.
    ranged = ranged.drop(hash_, tie).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = materialize(ranged, "mix-ranges")
    counts = ranged.groupBy(F.col(source_).alias("source"), F.col(part).alias("part")).agg(F.count("*").alias("n"), F.sum(size_).alias("words"), F.min(place).alias("first"))
    runs = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(runs), F.lit(0)) - F.col("first")), "mix-counts")
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = targets.withColumnRenamed("source", "of")
    plan = counts.join(targets, F.col("source").eqNullSafe(F.col("of"))).select("source", "part", "before", "source_size", "target", "rate")
    taken = [id_, source_, size_, part, place]
    names = free_names(docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.lit(0).alias(t) for t in taken)), "plan_source", "plan_part", "before", "source_size", "target", "rate", "copies")
    plan = plan.toDF(*names[:-1])
    plan = F.broadcast(plan) if counts.count() <= SENT_ROWS else plan
    plan_source, plan_part, before, source_size, target, rate, copies = names
    joined = ranged.join(plan, (F.col(part) == F.col(plan_part)) & F.col(source_).eqNullSafe(F.col(plan_source)))
    upto = lambda r: F.floor(r * F.col(rate) + source_offset(seed, source_))
    rank = F.col(before) + F.col(place)
    return joined.withColumn(copies, F.least(upto(rank + 1) - upto(rank), F.lit(most)).cast("long")), [id_, size_, source_size, target, copies]


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row; see the module's text."""
    planned, (_, size, source_size, target, copies) = _planned(docs.select("doc_id", "text", "source"), weights, most, seed, with_text=False)
    return planned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(size).alias("size"),
        F.col("source").cast("string").alias("source"),
        F.col(source_size).alias("source_size"),
        F.col(target).alias("target"),
        F.col(copies).alias("copies"),
        (F.col(copies) * F.col(size)).alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as its copies."""
    planned, (*_, copies) = _planned(docs, weights, most, seed)
    (time,) = free_names(planned, "time")
    times = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return planned.filter(F.col(copies) > 0).withColumn(time, times).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


#: The same in SQL. The order within a source is (size, doc_id); ranks times rates are the prefix sums.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS BIGINT) AS weight
  FROM sized GROUP BY source
), caps AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
  FROM sums
  WINDOW w AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap * weight_left <= remaining * weight AS is_full FROM caps
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0) AS DOUBLE) * weight
                   / CAST(sum(weight) FILTER (WHERE NOT is_full) OVER () AS DOUBLE) END AS target
  FROM marked
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
         CAST(concat('0x', substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS start_at
  FROM targets
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS r FROM sized
)
SELECT r.doc_id, r.size, s.source_size, s.target,
       CAST(least(floor(r.r * s.rate + s.start_at) - floor((r.r - 1) * s.rate + s.start_at), 3) AS BIGINT) * r.size AS taken
FROM ranked r JOIN rates s ON r.source IS NOT DISTINCT FROM s.source
"""
