"""Hard-negative mining by disjoint slots of scores.

The upper limits of an anchor's positives cut the scores into disjoint slots: slot s holds what lies at or below the limit of positive s
and above that of the next. A negative falls into one slot, however many windows overlap there. Blocks of anchors meet blocks of rows,
each keeps its best of every slot, and what blocks kept is merged slot by slot. As whole slots follow each other in descending order, the
answer to positive s is the head of slot s followed by the answer to positive s + 1; its lower limit only cuts the tail.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuetable.llm.common import table, written
from cuetable.plans.shipping import ship

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 4_096, 1_024, 128
NONE = -np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64; one beyond that raises OverflowError."""
    reach = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in exact[1]] for p in exact[0]], np.int64).reshape(len(a), len(b))


def heads(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first ``k`` allowed scores of each row, higher first; ties go to the earlier column."""
    n = scores.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if np.abs(scores.astype(float)).max(initial=0) * n < 2**62:
        keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), NONE)
    else:  # ranks instead of scores
        keys = np.where(allowed, np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1) * -1, NONE)
    take = min(k, n)
    best = np.argpartition(-keys, take - 1, 1)[:, :take] if take < n else np.broadcast_to(np.arange(n), keys.shape)
    row, column = np.repeat(np.arange(len(keys)), take), best.ravel()
    real = keys[row, column] != NONE
    return row[real], column[real]


def block_pairs(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, run: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame], form: str, d: int) -> DataFrame:
    """``run`` on every block of ``anchors`` with every block of ``rows``."""
    spot = F.xxhash64("row")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda n: F.pmod(spot, F.lit(n)).cast("int")
    columns = ["row", "vec_id", "label", "v", "limits", "low"]
    placed = rows.select(F.lit(False).alias("asks"), *columns[:4], F.lit(None).cast("array<bigint>").alias("limits"), F.lit(None).cast("bigint").alias("low"), one(blocks).alias("block"), every(anchor_blocks).alias("anchor_block")).unionAll(
        anchors.select(F.lit(True).alias("asks"), *columns, every(blocks).alias("block"), one(anchor_blocks).alias("anchor_block")))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        return run(group[asks], group[~asks].sort_values(["vec_id", "row"]), d)

    return placed.groupBy("block", "anchor_block").applyInPandas(pair, form)


def whole(vectors: pd.Series, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def first_positives(asks: pd.DataFrame, rows: pd.DataFrame, d: int, k: int) -> pd.DataFrame:
    """The first ``k`` other rows of each anchor's label."""
    x, label, row, ids = whole(rows["v"], d), rows["label"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
    out = []
    for at in range(0, len(asks), AT_ONCE):
        part = asks.iloc[at:at + AT_ONCE]
        own = part["row"].to_numpy()
        scores = products(whole(part["v"], d), x)
        r, c = heads(scores, (part["label"].to_numpy()[:, None] == label) & (own[:, None] != row), k)
        out.append(pd.DataFrame({"anchor": own[r], "row": row[c], "vec_id": ids[c], "score": scores[r, c]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "row": [], "vec_id": [], "score": []})


def slot_heads(asks: pd.DataFrame, rows: pd.DataFrame, d: int, k: int) -> pd.DataFrame:
    """The first ``k`` rows of other labels in each slot of each anchor."""
    x, label, row, ids = whole(rows["v"], d), rows["label"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
    out = []
    for at in range(0, len(asks), AT_ONCE):
        part = asks.iloc[at:at + AT_ONCE]
        own, low = part["row"].to_numpy(), part["low"].to_numpy(np.int64)
        limits = [list(x) for x in part["limits"]]
        scores = products(whole(part["v"], d), x)
        other = (part["label"].to_numpy()[:, None] != label) & (scores >= low[:, None])
        for s in range(max(map(len, limits), default=0)):
            upper = np.array([u[s] if s < len(u) else NONE for u in limits], np.int64)
            under = np.array([u[s + 1] if s + 1 < len(u) else NONE for u in limits], np.int64)
            r, c = heads(scores, other & (scores <= upper[:, None]) & (scores > under[:, None]), k)
            out.append(pd.DataFrame({"anchor": own[r], "slot": np.full(len(r), s + 1), "row": row[c], "vec_id": ids[c], "score": scores[r, c]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "slot": [], "row": [], "vec_id": [], "score": []})


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; each task keeps its own ``k`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors of ``vectors`` (``vec_id, label, embedding``).

    Each component x counts as floor(scale * x); scores are whole inner products with the anchor, higher first, ties to smaller vec_id. An
    anchor's positives are its first ``positives`` other rows of its label; each is given the first ``negatives`` rows of other labels that
    score from ``low`` to ``high`` hundredths of it. Null ids, labels and vectors and null or non-finite components take no part;
    shorter vectors count as padded with zeros. Rows that repeat a vec_id stand for themselves, as other rows too. A positive without a row in its
    window gives none; an empty table gives none. Other columns are not read. A score beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"), is_anchor.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", scaled.alias("v"), F.coalesce("asks", F.lit(False)).alias("asks")), "rows")
    n, asking, d = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, anchor_blocks = -(-n // ROW_BLOCK) or 1, -(-asking // ANCHOR_BLOCK) or 1
    plain = rows.select("row", "vec_id", "label", "v")
    anchors = rows.filter("asks").select("row", "vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("limits"), F.lit(None).cast("bigint").alias("low"))
    found = block_pairs(plain, anchors, blocks, anchor_blocks, lambda a, r, d: first_positives(a, r, d, positives), "anchor bigint, row bigint, vec_id bigint, score bigint", d)
    own = first_of(found, ["anchor"], positives).select("anchor", F.struct(F.col("rank").alias("slot"), F.col("vec_id").alias("id"), "score").alias("p"))
    own = written(own.groupBy("anchor").agg(F.sort_array(F.collect_list("p")).alias("positives")), "positives")  # as many as asked for
    score = F.col("positives.score")
    limits = F.transform(score, lambda s: F.floor(s.cast("decimal(28,0)") * F.lit(high) / F.lit(100)).cast("bigint"))
    lowest = F.array_min(F.transform(score, lambda s: F.ceil(s.cast("decimal(28,0)") * F.lit(low) / F.lit(100)).cast("bigint")))
    limited = anchors.drop("limits", "low").join(own.select(F.col("anchor").alias("row"), limits.alias("limits"), lowest.alias("low")), "row")
    slots = block_pairs(plain, limited.select("row", "vec_id", "label", "v", "limits", "low"), blocks, anchor_blocks, lambda a, r, d: slot_heads(a, r, d, negatives), "anchor bigint, slot int, row bigint, vec_id bigint, score bigint", d)
    slots = first_of(slots, ["anchor", "slot"], negatives).groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("head"))
    heads_of = slots.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "head"))).alias("heads"))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<rank: INT, vec_id: BIGINT, score: BIGINT>>)")
    last = F.size("positives")
    # Slots are disjoint and descending: the answer to a positive is the head of its slot and then the answer to the next positive.
    merged = F.aggregate(F.sequence(F.lit(1), last), F.array(empty), lambda done, s: F.concat(
        F.array(F.slice(F.concat(F.coalesce(F.try_element_at("heads", last - s + 1), empty), F.get(done, F.lit(0))), 1, negatives)), done))
    answers = own.join(heads_of, "anchor").select("anchor", F.posexplode("positives").alias("at", "p"), merged.alias("answers"))
    answers = answers.select("anchor", "p", F.posexplode(F.filter(F.get("answers", F.col("at")), lambda x: x["score"].cast("decimal(28,0)") * 100 >= F.col("p.score").cast("decimal(28,0)") * low)).alias("nth", "x"))
    named = rows.filter("asks").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return answers.join(named, "anchor").select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("nth") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"),
                                                F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL_HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, o.label = a.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM e a, e o WHERE a.vec_id % 100 = 0 AND o.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": SQL_HARD_NEGATIVES}
