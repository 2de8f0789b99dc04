"""Spelling variants by a frontier of states over relational tries.

Words that differ by one edit agree up to the place of the edit and from there on. A trie of the words is grown level by level as tables:
the words under a node agree up to where the smallest and the largest of them part, and each next character opens a child. Beside it runs the
frontier: a state is a word, the node it reached (which tells the position) and its edits. Words without an edit stand on their own paths;
where a path parts, the other children are entered by a replaced, an inserted or a deleted character. Edited states must then
follow the edges of the next levels exactly; the leaves they end at are their words' neighbours.

Of a pair, the common beginning or the common end has half of the characters at least. So the words stand in one trie and, reversed, in
another, edits are tried in the second half alone, and no state starts at a node near the root, where all words meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import table, written

LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = r"A-Za-zÀ-ÿ", 7, 2, 10, 31
#: Characters that a broadcast table may have.
LIGHT = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of the two tries before a word, and of a word's end; no letters.
FORWARD, BACKWARD, END = "<", ">", "$"


def parting(a: Column, b: Column) -> Column:
    """How many first characters two different strings share."""
    return F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True) - 1


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """``word, n`` of the runs of letters; every ``damaged``-th by checksum of document and run has lost a character."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # where lower() touches A-Z alone
    run = run.select("doc", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    run = run.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = run.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter(F.col("n") >= least_count)


def tops(groups: DataFrame) -> DataFrame:
    """Nodes ``g, d`` among groups with ``least, most, n``: those of several words, and how much these share."""
    return groups.filter("n > 1").select("g", parting(F.col("least"), F.col("most")).cast("int").alias("d"))


def light(df: DataFrame, size: Column) -> DataFrame:
    """``df``, written, with a broadcast hint where its rows and their strings (``size``, in characters) have been added up to little."""
    rows, characters = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= LIGHT // 40 and characters <= LIGHT else df


def entered(paths: DataFrame) -> DataFrame:
    """``text, found, h, to, leaf``: states of words ``text`` at ``d`` that one edit takes into another child ``label, h, to, leaf, nexts``.

    The child must go on with the edited word's next character, so most states that would die at the next level are never made.
    """
    own, rest = F.expr("substring(text, d + 1, 1)"), F.expr("substring(text, d + 2)")
    before, c = F.expr("substring(text, 1, d)"), F.expr("substring(label, 1, 1)")
    replaced = F.when((c != END) & (own != END), F.concat(before, c, rest))
    inserted = F.when(c != END, F.concat(before, c, own, rest))
    deleted = F.when((own != END) & (F.substring(rest, 1, 1) == c), F.concat(before, rest))
    made = paths.filter(c != own).select("*", F.explode(F.array(replaced, inserted, deleted)).alias("found"))
    made = made.filter("found IS NOT NULL AND substring(found, d + 1, length(label)) = label")
    return made.filter("leaf OR instr(nexts, substring(found, to + 1, 1)) > 0").select("text", "found", "h", "to", "leaf")


def grown(words: DataFrame, least_length: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Level by level, the words' paths ``text, g, d`` and the edges ``g, d, h, to, leaf, label`` of the nodes ``g`` there."""
    both = words.select(F.explode(F.array(F.concat(F.lit(FORWARD), "word", F.lit(END)), F.concat(F.lit(BACKWARD), F.reverse("word"), F.lit(END)))).alias("text"))
    own = written(both.withColumn("g", F.substring("text", 1, 1 + least_length // 2)), "paths")
    ends = [F.min("text").alias("least"), F.max("text").alias("most"), F.count(F.lit(1)).alias("n")]
    nodes = written(tops(own.groupBy("g").agg(*ends)), "nodes")
    while True:  # as often as the deepest path parts
        own = written(own.join(light(nodes, F.length("g")), "g").select("text", "g", "d", F.expr("substring(text, 1, d + 1)").alias("h")), "paths")
        if own.isEmpty():
            return
        kids = own.groupBy("g", "d", "h").agg(*ends)
        to = F.when(F.col("n") > 1, parting(F.col("least"), F.col("most")).cast("int")).otherwise(F.length("least"))
        kids = written(kids.withColumn("to", to).select("g", "d", "h", "to", (F.col("n") == 1).alias("leaf"), F.expr("substring(least, d + 1, to - d)").alias("label")), "edges")
        yield own, kids
        own, nodes = own.select("text", F.col("h").alias("g")), kids.filter("NOT leaf").select(F.col("h").alias("g"), F.col("to").alias("d"))


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, near``: both orders of all pairs of distinct ``word``s of ``least_length`` letters or more that one edit of one character parts."""
    none = words.select(F.col("word").alias("text"), F.col("word").alias("found"), F.col("word").alias("g")).limit(0)
    states, leaves, levels = none, [], grown(words, least_length)
    level = next(levels, None)
    while level:
        (own, kids), level = level, next(levels, None)  # the edges of the next level say how children go on
        if level:
            onward = written(level[1].groupBy(F.col("g").alias("h")).agg(F.array_join(F.collect_list(F.expr("substring(label, 1, 1)")), "").alias("nexts")), "onward")  # a letter each
            edges = kids.join(light(onward, F.length("h") + F.length("nexts")), "h", "left")
        else:
            edges = kids.withColumn("nexts", F.lit(""))  # leaves go on with nothing
        edges = light(written(edges, "edges"), F.length("label") + F.length("h") + F.length("g"))
        goes_on = "substring(found, d + 1, length(label)) = label AND (leaf OR instr(nexts, substring(found, to + 1, 1)) > 0)"
        followed = states.join(edges, "g").filter(goes_on).select("text", "found", "h", "to", "leaf")
        parted = own.filter("2 * d >= length(text) - 1").select("text", "g").join(edges, "g")
        reached = written(entered(parted).unionAll(followed), "states")
        leaves.append(reached.filter("leaf").select("text", "found"))
        states = reached.filter("NOT leaf").select("text", "found", F.col("h").alias("g"))
    if not leaves:
        return none.select(F.col("text").alias("word"), F.col("found").alias("near"))
    bare = lambda c: F.when(F.substring("text", 1, 1) == FORWARD, F.expr(f"substring({c}, 2, length({c}) - 2)")).otherwise(F.reverse(F.expr(f"substring({c}, 2, length({c}) - 2)")))
    return reduce(DataFrame.unionAll, leaves).select(bare("text").alias("word"), bare("found").alias("near")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``form`` ends, for every row of ``forms`` (``word, form``, none null, without a ring)."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = roots.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        further = written(further, "roots")
        roots = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return roots


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``; distinct, of ``least_length`` letters or more)."""
    words = written(words.select("word", "n"), "words")
    pairs = neighbours(words, least_length).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    largest = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), largest.alias("best"))
    known = words.join(near, "word", "left").withColumn("taken", -F.col("best.less") >= ratio * F.col("n"))
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("taken"), F.col("best.near")).alias("form"),
                                 F.when(F.col("taken"), -F.col("best.less")).alias("form_n")), "forms")
    roots = last_forms(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, damaged: int = DAMAGED) -> DataFrame:
    """The words of ``docs`` with the near word that each is a variant of: ``word, form, root, n, n_near, form_n``.

    Words are runs of Latin letters of whole texts, A-Z in lower case; a null or empty text has none, and a null doc_id counts as an empty
    one in the checksum. Each row counts, repeated ones too. ``form`` is the near word of largest ``n``, the smallest in order of
    code points among equals, if that is ``ratio`` times the word's; ``root`` is where forms end. Other columns are not read; an empty table has no words. Words may be of any length.
    """
    return variants(counted(docs, least_length, least_count, damaged), least_length, ratio)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL_SPELLING = """
WITH RECURSIVE runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc || ':' || run AS s, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT *, list_transform(range(0, strlen(s)), lambda i: CAST('0x' || substr(hex(s), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM per_doc),
sums AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: list_reduce(
    list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS h
  FROM bytes),
hit AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM sums),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM hit WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.near),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN forms f ON f.word = walk.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": SQL_SPELLING}
