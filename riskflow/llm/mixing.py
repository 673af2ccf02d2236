"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.functions.prefix import running_totals
from riskflow.llm.common import sent_if_small, table
from riskflow.session import freeze

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MAX_REPEATS = 3
#: Cells of the shuffled order of one source, and of the common queue: a task sorts one cell's rows.
CELL_BITS = 14


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """All columns of ``docs`` with size, place in the shuffled order of the source, and that order's cell."""
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.concat_ws(":", F.lit(seed), docs["doc_id"].cast("string"), docs["source"], F.col("_op6_size").cast("string")))
    place = F.conv(F.substring(place, 1, 15), 16, 10).cast("long")
    return docs.withColumns({"_op6_size": size, "_op6_source": docs["source"], "_op6_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))}).withColumn(
        "_op6_place", place).withColumn("_op6_cell", F.shiftright("_op6_place", 60 - CELL_BITS).cast("int"))


def _targets(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, int]:
    """One row a source with rank, size and target, and the total size.

    Target = min(weight * level, repeats * size): the level at which the targets fill the total, found from the sources in
    the order in which they reach their limit.
    """
    sources = freeze(sized.groupBy("_op6_source").agg(F.sum("_op6_size").alias("_op6_all")))
    total = int(sources.agg(F.coalesce(F.sum("_op6_all"), F.lit(0))).first()[0])
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("_op6_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_op6_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("_op6_rank", rank).withColumn("_op6_weight", weight)
    limit = (F.col("_op6_all") * repeats).cast("double")
    ranked = ranked.withColumn("_op6_limit", limit).withColumn("_op6_full", limit / F.col("_op6_weight"))
    order = everything.orderBy("_op6_full", "_op6_rank")
    filled = ranked.select(
        "_op6_full", "_op6_rank",
        F.coalesce(F.sum("_op6_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("spent"),
        F.sum("_op6_weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    reach = filled.where(F.col("spent") + F.col("_op6_full") * F.col("rest") >= F.lit(float(total)))
    level = reach.select(F.struct("_op6_full", "_op6_rank", ((F.lit(float(total)) - F.col("spent")) / F.col("rest")).alias("level")).alias("x")).agg(F.min("x.level").alias("any"), F.min("x").alias("x")).first()
    level = level["x"]["level"] if level["x"] is not None else 0.0
    return ranked.select("_op6_source", "_op6_all", "_op6_rank", F.least(F.col("_op6_weight") * F.lit(level), F.col("_op6_limit")).alias("_op6_target")), total


def _queued(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row with the size of its source before it (``_op6_size_before``), and its source's figures."""
    known = sized.join(sent_if_small(targets).withColumnRenamed("_op6_source", "_op6_same"), F.col("_op6_source").eqNullSafe(F.col("_op6_same"))).drop("_op6_same")
    return running_totals(known, ["_op6_rank"], ["_op6_cell"], ["_op6_place", "_op6_id", "_op6_size"], ["_op6_size"])


def _finish(repeat: Column) -> Column:
    """Virtual finish time of a row's n-th turn: the source's words up to its end, divided by the source's target."""
    return (repeat * F.col("_op6_all") + F.col("_op6_size_before") + F.col("_op6_size")).cast("double") / F.col("_op6_target")


def _begins(repeat: Column) -> Column:
    """A source's queue ends with the document that reaches its target."""
    return (repeat * F.col("_op6_all") + F.col("_op6_size_before")).cast("double") < F.col("_op6_target")


def _key(repeat: Column) -> Column:
    return F.struct(_finish(repeat).alias("finish"), F.col("_op6_rank").alias("rank"), F.col("_op6_place").alias("place"),
                    F.col("_op6_id").alias("id"), F.col("_op6_size").alias("size"), repeat.alias("turn"))


def _cut(queued: DataFrame, total: int, repeats: int):
    """The last turn taken: all turns are ordered by finish time, and those go whose running size exceeds the total."""
    turns = F.array(*[F.lit(i).cast("long") for i in range(repeats)])
    found = queued.where("_op6_size > 0 and _op6_target > 0").withColumn("_op6_turn", F.explode(F.filter(turns, _begins)))
    found = found.select(_key(F.col("_op6_turn")).alias("k")).select("k.*")
    cells = float(1 << CELL_BITS)
    found = found.withColumn("cell", F.least(F.floor(F.col("finish") * F.lit(cells)), F.lit(int(cells)).cast("long")))
    run = running_totals(found, [], ["cell"], ["finish", "rank", "place", "id", "size", "turn"], ["size"])
    last = run.where(F.col("size_before") + F.col("size") <= F.lit(total)).agg(F.max(F.struct("finish", "rank", "place", "id", "size", "turn")).alias("k")).first()["k"]
    return None if last is None else F.struct(*[F.lit(v).cast(t).alias(n) for (n, v), t in zip(last.asDict().items(), ("double", "int", "long", "long", "long", "long"))])


def _turns(cut, repeats: int) -> Column:
    if cut is None:
        return F.lit(0).cast("long")
    one = [F.when(_begins(F.lit(i).cast("long")) & (_key(F.lit(i).cast("long")) <= cut), F.lit(1)).otherwise(F.lit(0)) for i in range(repeats)]
    return F.when(F.col("_op6_size") > 0, sum(one[1:], one[0])).otherwise(F.lit(0)).cast("long")


def _planned(docs: DataFrame, weights: tuple[int, ...], repeats: int, seed: str):
    own = freeze(_sized(docs.select("doc_id", "source", "text"), seed).drop("text", "source"))
    targets, total = _targets(own, weights, repeats)
    targets = freeze(targets)
    return own, targets, _cut(_queued(own, targets), total, repeats)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (``doc_id``, ``text``, ``source``; others are ignored).

    ``size`` is the number of words (null text: 0); ``taken`` is how many words the mix takes, a document's repeats counted. The documents
    of a source queue in an order fixed by hashes of id, source and size; repeated rows follow each other in it. A null
    source is a source, the last. Documents without a word and tables without a word are taken 0 times.
    """
    own, targets, cut = _planned(docs, weights, repeats, seed)
    return _queued(own, targets).select("doc_id", F.col("_op6_size").alias("size"), F.col("_op6_all").alias("source_size"),
                                        F.col("_op6_target").alias("target"), (_turns(cut, repeats) * F.col("_op6_size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it (0 to ``repeats`` times), with all columns."""
    _, targets, cut = _planned(docs, weights, repeats, seed)
    queued = _queued(_sized(docs, seed), targets).withColumn("_op6_turns", _turns(cut, repeats).cast("int")).where("_op6_turns > 0")
    return queued.withColumn("_op6_turn", F.explode(F.sequence(F.lit(1), F.col("_op6_turns")))).select(docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, (source_size * 3)::DOUBLE AS lim FROM r),
f AS (SELECT *, lim / weight AS full_at, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM w),
g AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS spent,
    sum(weight) OVER (ORDER BY full_at, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f),
v AS (SELECT arg_min((total - spent) / rest, rnk) AS level FROM g WHERE full_at = (SELECT min(full_at) FROM g WHERE spent + full_at * rest >= total) AND spent + full_at * rest >= total),
t AS (SELECT source, source_size, rnk, least(weight * level, lim) AS target FROM g, v),
q AS MATERIALIZED (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk,
    ('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), d.source, CAST(size AS VARCHAR))), 1, 15))::BIGINT AS place,
    row_number() OVER () AS uid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, sum(size) OVER (PARTITION BY rnk ORDER BY place, doc_id, size, uid ROWS UNBOUNDED PRECEDING) AS upto FROM q),
e AS (
  SELECT uid, doc_id, size, rnk, place, turn, (turn * source_size + upto)::DOUBLE / target AS finish
  FROM b, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0 AND (turn * source_size + upto - size)::DOUBLE < target),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, place, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS running FROM e),
k AS (SELECT uid, sum(size) AS taken FROM c WHERE running <= (SELECT sum(source_size) FROM s) GROUP BY uid)
SELECT b.doc_id, b.size, b.source_size, b.target, coalesce(k.taken, 0)::BIGINT AS taken FROM b LEFT JOIN k USING (uid)
"""
