"""Near-duplicates through bottom-k sketches of one hash function.

A document's sketch holds the smallest hashes of its shingles. Documents of similarity 0.8 agree on most of the smallest hashes of
their union, so two values that stand side by side in one sketch stand side by side in the other too, many times over: lists inverted
on such neighbouring values bring similar documents together and hardly others. The union of two sketches estimates the similarity, and
what passes is verified on the full sets.

No list is paired off when it is long. Texts of equal words are one node from the start. Nodes that share a short list are paired. A
partner missed by that shares long lists alone, so both are crowded: they stand in a long list. Crowded nodes are listed by single values too, the first
ones of their sketches that stand in no long list: who has more of them in short lists than a partner can lack meets its partners there. For the rest, long lists elect
the node whose values are the most common ones, which in a group of copies is the text that they come from, and those who vote there are compared with
it. A node votes in the first few of its lists, in one order for all, as copies share most lists and would meet one leader in each; only components are asked for, so who lies in a list's
largest component is done. Who is still apart after a few elections is compared with all others
of all its lists by bit maps of whole sets, in which similar pairs and hardly others agree; a pair comes out of the first list that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import Rolling, given_back, mixed, slices, table, text_buffer, texts, tidied, word_bounds, written
from cuetable.llm.components import components
from cuetable.plans.sizes import broadcast_if_small

WORDS, SIMILAR = 5, 80
SKETCH, SHORT, OWN_VALUES, ESTIMATE, LEADERS = 64, 32, 28, 0.5, 2
#: Long lists in which a node takes part in elections.
VOTES = 8
#: Values listed beyond those needed, and the most longs of the bit map of values in long lists.
SPARE, LONG_MAP = 4, 16_384
#: Bits of a bit map, and how many of the smallest hashes it takes.
BITS, MAPPED = 4_096, 512
#: Nodes of one block of a list, and askers it meets.
LISTED, ASKING = 8_000, 4_000
#: Texts that one leader's text is read with at a time.
SHARE = 500
#: Sets of up to so many shingles are listed by pairs of values, of at least so many by triples; similar sets meet in one or the other.
PAIRS_TO, TRIPLES_FROM = 15, 8


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For every text its sorted distinct shingle hashes; ``data`` is lower case."""
    starts, ends, counts = word_bounds(data, offsets)
    each = Rolling(data).of(starts, ends)
    joined = np.zeros(len(each), np.uint64)
    size = max(len(each) - words + 1, 0)
    for k in range(words):
        joined[:size] = joined[:size] * np.uint64(0xD6E8FEB86659FD93) + each[k:k + size]
    joined = mixed(joined)
    first = np.cumsum(counts) - counts
    for a, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n >= words:
            yield np.unique(joined[a:a + n - words + 1])
        elif n:
            whole = np.uint64(n)
            for h in each[a:a + n]:
                whole = mixed(np.array([whole * np.uint64(0xA0761D6478BD642F) + h]))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """One bit for each hash, as longs."""
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes >> np.uint64(7)) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64)


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``row, doc_id, place, n, same, sketch, map``: one row per row of ``docs``; ``same`` names its sequence of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        with np.errstate(over="ignore"):
            for batch in batches:
                for rows in slices(batch):
                    data, offsets = text_buffer(rows.column("text"))
                    data = lower(data)
                    raw = data.tobytes()
                    same = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    sets = list(shingle_hashes(data, offsets, words))
                    sketch = [h[:SKETCH].view(np.int64) for h in sets]
                    maps = [bit_map(h[:MAPPED]) for h in sets]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(row, row + len(sets))), rows.column("doc_id"), rows.column("place"), pa.array([len(h) for h in sets], pa.int64()),
                        pa.array(same, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], ["row", "doc_id", "place", "n", "same", "sketch", "map"])
                    row += len(sets)

    rows = texts(docs).withColumn("place", F.xxhash64("text"))
    return rows.mapInArrow(tidied(run), "row bigint, doc_id bigint, place bigint, n bigint, same binary, sketch array<bigint>, map array<bigint>")


def triple(at: Column) -> Column:
    return F.xxhash64(*[F.get("sketch", at + k) for k in range(3)])


def pair(at: Column) -> Column:
    return F.xxhash64(*[F.get("sketch", at + k) for k in range(2)])


def list_keys(nodes: DataFrame) -> DataFrame:
    """``key, node``: the inverted lists each node stands in; a sketch of one value keys that value."""
    size, none = F.size("sketch"), F.array().cast("array<bigint>")
    triples = F.when(F.col("n") >= TRIPLES_FROM, F.transform(F.sequence(F.lit(0), size - 3), triple)).otherwise(none)
    pairs = F.when(F.col("n").between(2, PAIRS_TO), F.transform(F.sequence(F.lit(0), size - 2), pair)).otherwise(none)
    keys = F.when(F.col("n") == 1, F.transform("sketch", lambda v: F.xxhash64(v))).otherwise(F.concat(triples, pairs))
    return nodes.select("node", F.explode(keys).alias("key"))


def close_in_size(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def of_pairs(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``table`` (``node, ...``) that ``pairs`` speak of."""
    ids = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    return table.join(broadcast_if_small(written(ids, "ids"), 500_000), "node", "left_semi")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sizes and sketches do not rule out the similarity asked for."""
    pairs = written(pairs.filter("a <> b"), "pairs")
    held = written(of_pairs(pairs, nodes.select("node", "n", "sketch")), "sketched")
    one = held.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    other = held.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    sized = pairs.join(one.drop("sa"), "a").join(other.drop("sb"), "b").filter(close_in_size(F.col("na"), F.col("nb"))).select("a", "b")
    union = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), _unsigned)), 1, SKETCH)
    both = F.array_intersect(union, F.transform(F.array_intersect("sa", "sb"), _unsigned))
    near = sized.join(one.drop("na"), "a").join(other.drop("nb"), "b")
    return near.filter(F.size(both) >= F.size(union) * ESTIMATE).select("a", "b")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that do not lie in one component."""
    return pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left").filter(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def most_unlike(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many bits of just one of two bit maps leave the pair to the similarity asked for.

    Whole sets of similarity s differ in (1 - s) / (1 + s) of their sizes together, and bits that fall on each other only make them more alike. Sets cut
    to their smallest hashes may differ in a fifth and by what one cut leaves out more than the other, six deviations above what is to be expected.
    """
    whole = np.floor((na + nb) * (100 - SIMILAR) / (100 + SIMILAR) + 1e-9)
    cut = (np.minimum(na, MAPPED) + np.minimum(nb, MAPPED)) * 0.2 + MAPPED * (1 - np.minimum(na, nb) / np.maximum(na, nb))
    return np.where(np.maximum(na, nb) <= MAPPED, whole, cut)


def alike(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of asking and listed nodes of one block that may be alike, are not in one component and share no list of a smaller key."""
    asks = group["asks"].to_numpy(bool)
    x, y = group[asks], group[~asks]
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    key = x["key"].iloc[0]
    maps, n, root, node = np.stack(y["map"].to_list()).view(np.uint64), y["n"].to_numpy(), y["root"].to_numpy(), y["node"].to_numpy()
    before = [k[k < key] for k in y["keys"]]
    others = np.full((len(y), max(map(len, before))), key)
    for row, k in zip(others, before, strict=True):
        row[:len(k)] = k
    out = []
    for own, size, part, bits, keys in zip(x["node"].to_numpy(), x["n"].to_numpy(), x["root"].to_numpy(), x["map"], x["keys"], strict=True):
        near = np.flatnonzero((root != part) & (100 * np.minimum(n, size) >= SIMILAR * np.maximum(n, size)))
        unlike = np.bitwise_count(maps[near] ^ bits.view(np.uint64)).sum(1)  # of signed numbers it counts the magnitude's
        near = near[unlike <= most_unlike(n[near], size)]
        found = node[near[~np.isin(others[near], keys[keys < key]).any(1)]]
        out.append(np.stack([np.minimum(found, own), np.maximum(found, own)]))
    a, b = np.concatenate(out, 1)
    del maps, others, before, out
    given_back()
    return pd.DataFrame({"a": a, "b": b})


def paired_alike(waiting: DataFrame, lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of ``waiting`` and ``lists`` (``key, node, n, root``) that share a list, may be alike by their bit maps and are not in one component.

    Each list is cut into blocks of askers and of listed nodes; a pair of blocks is one group, of which only what is alike comes back. Who shares
    several lists is found in the first: there one of the two waits too, as the largest component does not hold both.
    """
    columns = ["key", "node", "n", "root"]
    held = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("blocks"))
    held = held.join(waiting.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("askers")), "key")
    held = broadcast_if_small(written(held, "blocks"))
    one, every = F.xxhash64("node"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spot = lambda c: F.array(F.pmod(one, c).cast("int"))
    x = waiting.select(*columns, F.lit(True).alias("asks")).join(held, "key").withColumns({"block": every("blocks"), "asker": spot("askers")})
    y = lists.select(*columns, F.lit(False).alias("asks")).join(held, "key").withColumns({"block": spot("blocks"), "asker": every("askers")})
    placed = x.unionByName(y).withColumn("block", F.explode("block")).withColumn("asker", F.explode("asker")).drop("blocks", "askers")
    maps = nodes.select("node", "map").join(lists.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    return placed.join(maps, "node").groupBy("key", "block", "asker").applyInPandas(alike, "a bigint, b bigint").distinct()


def long_values(long: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row ``words``: a bit map of the values that the keys of ``long`` lists are made of, of a size that follows their number."""
    keys = lambda i: F.array(*[triple(i - k) for k in range(3)], *[pair(i - k) for k in range(2)], F.xxhash64(F.get("sketch", i)))
    one = long.groupBy("key").agg(F.min("node").alias("node")).join(nodes.select("node", "sketch"), "node")
    values = written(one.select(F.explode(F.filter("sketch", lambda v, i: F.array_contains(keys(i), F.col("key")))).alias("value")).distinct(), "long-values")
    size = min(LONG_MAP, 1 << (values.count() // 4).bit_length())
    at = F.pmod("value", F.lit(64 * size))
    bits = values.groupBy(F.floor(at / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))).alias("bits"))
    filled = long.sparkSession.range(size).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("w"))
    return written(filled.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"]).alias("words")), "long-map")


def short_values(crowd: DataFrame, long: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node`` of those in ``crowd`` with enough values in short lists to meet all their partners, and the pairs ``a, b`` that meet there.

    The lists hold the first values of every sketch in ``crowd`` outside ``long_values``, which come last in one order for all. A set that the sketch
    holds whole differs from a similar one in a fifth of its values at most. Of two sketches that each lack fewer of the other's values than ``enough``, the
    first ``enough + k`` share more than ``k`` values, for any ``k``; with at most ``k`` of a node's in longer lists, it meets the other in a short one.
    """
    enough = F.when(F.col("n") <= SKETCH, F.floor(F.col("n") / 4) + 1).otherwise(OWN_VALUES).cast("int")
    at = lambda v: F.pmod(v, F.lit(64) * F.size("words"))
    rest = F.filter("sketch", lambda v: F.getbit(F.get("words", F.floor(at(v) / 64).cast("int")), (at(v) % 64).cast("int")) == 0)
    values = crowd.crossJoin(F.broadcast(long_values(long, nodes))).select("node", "n", F.explode(F.slice(rest, F.lit(1), enough + SPARE)).alias("key"))
    values = written(values, "listed")
    values = written(values.join(values.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") <= SHORT), "key"), "values")
    free = written(values.groupBy("node", "n").agg(F.count(F.lit(1)).alias("own")).filter(F.col("own") >= enough).select("node"), "free")
    listed = values.filter("held > 1")
    x, y = listed.join(free, "node", "left_semi").alias("x"), listed.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & close_in_size(F.col("x.n"), F.col("y.n")))
    return free, met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def paired(lists: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of ``lists`` (``key, node``) that share a list, are close in size and not in one component."""
    placed = nodes.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    placed = lists.join(placed, "node")
    x, y = placed.alias("x"), placed.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & close_in_size(F.col("x.n"), F.col("y.n"))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def voting(lists: DataFrame) -> DataFrame:
    """Of ``lists``, the first ``VOTES`` rows of every node by ``key``, which is a hash."""
    held = lists.groupBy("node", "n", "common").agg(F.slice(F.sort_array(F.collect_list("key")), 1, VOTES).alias("keys"))
    return held.select(F.explode("keys").alias("key"), "node", "n", "common")


def outside(lists: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists`` with the ``root`` of every node, and of these the rows outside the largest component of their list.

    A pair that is apart has one node there, in every list that it shares.
    """
    placed = written(lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held")).groupBy("key").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.count(F.lit(1)).alias("parts"))
    waiting = placed.join(parts.filter("parts > 1"), "key").filter("root <> main").select("key", "node", "n", "common", "root")
    return placed, written(waiting, "waiting")


def _unsigned(x: Column) -> Column:
    """Order of unsigned numbers for signed ones."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, unique: bool) -> DataFrame:
    """Pairs whose full shingle sets, built from the texts, have the similarity asked for.

    The node with more partners comes first; its text is read once for ``SHARE`` of them, before theirs.
    """
    degree = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    degree = written(degree, "degrees")
    of = lambda c: degree.select(F.col("node").alias(c), F.struct("held", "node").alias(f"d{c}"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b").select(F.greatest("da", "db").alias("x"), F.least("da", "db").alias("y"))
    turned = turned.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.ceil(F.col("x.held") / SHARE).cast("int").alias("parts"))
    turned = written(turned.withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")), "turned")
    needed = broadcast_if_small(written(of_pairs(pairs, nodes.select("node", "doc", "place")), "needed"), 500_000)
    own = texts(docs).select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_place"), "text")
    its = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_place") == F.col("place"))
    if not unique:  # of rows alike in id and text, one
        own = own.join(needed, its, "left_semi").groupBy("_doc", "_place").agg(F.first("text").alias("text"))
    read = written(own.join(needed, its).select("node", "text"), "texts")
    leading = turned.select("a", "part").distinct().join(read.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    partners = turned.join(read.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    laid = leading.unionAll(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def shingles(text: str) -> set:
        w = text.encode().lower().split()
        return set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: set = set()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at, (b, text) in enumerate(zip(batch.column("b"), batch.column("text"), strict=True)):
                if not b.is_valid:
                    left = shingles(text.as_py())
                    continue
                right = shingles(text.as_py())
                met = len(left & right)
                keep[at] = 100 * met >= SIMILAR * (len(left) + len(right) - met)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return laid.mapInArrow(tidied(run), "a bigint, b bigint")


def near_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, place, n_shingles, component_id, kept``; ``place`` is a hash of the text.

    Words are what stands between ASCII blanks, A-Z in lower case. A text's set has its distinct runs of ``words`` words; fewer words are
    one shingle as a whole; without words, or null, it is empty and linked with nothing. Texts are linked when their sets overlap to 80
    of 100; ``component_id`` is the smallest doc_id that links reach. Rows that repeat a doc_id are judged by their own texts. A null
    doc_id counts only where its component has no other. Other columns are not read.
    """
    rows = written(sketches(docs, words), "sketches")
    full = rows.filter("n > 0")
    unique = rows.select("doc_id").groupBy("doc_id").count().filter("count > 1").isEmpty()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "place", "row"))
    nodes = full.groupBy("same").agg(first.alias("f"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("map").alias("map"))
    nodes = written(nodes.select("same", F.col("f.row").alias("node"), "f.doc", "f.place", "n", "sketch", "map"), "nodes")
    keys = list_keys(nodes)
    members = written(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "key"), "members")
    long = members.filter(F.col("held") > SHORT)
    common = long.groupBy("node").agg(F.sum(F.log2("held")).alias("common"))
    crowd = written(nodes.select("node", "n", "sketch").join(common, "node"), "crowd")
    free, met = short_values(crowd, long, nodes)
    roots = nodes.select("node", F.col("node").alias("root")).limit(0)

    def link(pairs: DataFrame) -> None:
        """Joins the components of pairs that are links."""
        nonlocal roots
        pairs = written(estimated(apart(pairs, roots), nodes), "pairs")
        if pairs.isEmpty():
            return
        new = written(verified(pairs, nodes, docs, words, unique), "links")
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        met = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        moved = components(met)  # of roots
        old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(old.unionAll(moved.join(roots.select("node"), "node", "left_anti")), "roots")

    link(paired(members.filter(F.col("held") <= SHORT).select("key", "node"), nodes, roots).unionAll(met).distinct())
    lists = written(long.select("key", "node").join(crowd.join(free, "node", "left_anti").select("node", "n", "common"), "node"), "lists")
    votes, led = written(voting(lists), "votes"), None
    for _ in range(LEADERS):
        placed, waiting = outside(votes, roots)
        if led is not None:  # who led a list was compared with all who vote there
            waiting = written(waiting.join(led, ["key", "node"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        leader = written(waiting.groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("common", F.xxhash64("node"))).alias("l")).select("key", F.col("l.node").alias("a"), F.col("l.root").alias("ra")), "leaders")
        led = leader.select("key", F.col("a").alias("node")) if led is None else led.unionAll(leader.select("key", F.col("a").alias("node")))
        link(placed.join(leader, "key").filter("root <> ra").select("a", F.col("node").alias("b")).distinct())
    placed, waiting = outside(lists, roots)
    if not waiting.isEmpty():
        link(paired_alike(waiting, placed, nodes))
    placed = nodes.join(roots, "node", "left").select("same", "doc", F.coalesce("root", "node").alias("root"))
    reached = placed.join(placed.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("same", "component_id")
    out = rows.select("doc_id", "place", "same", F.col("n").alias("n_shingles")).join(reached, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "place", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2).drop("place")


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES: dict[str, str] = {}
