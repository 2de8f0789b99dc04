"""Text, classification and caption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetable import bindings as b
from cuetable.checks.timeline import DAY
from cuetable.functions import ids, text, timing
from cuetable.operators import captions, classify, model, names
from cuetable.plans.ordered import by_position, ordered

QUERIES, SQL = {}, {}

# The given texts are invented prose, so the terms are frequent substrings of it.
TERMS = {"benefit": ["eaux", "erin", "ingth"], "selling_point": ["lich", "wher", "elle", "ly "], "remove": ["ado", "atio", "und"]}
PATTERNS = {"benefit": "th\\w*ing|rein", "selling_point": "of(?: the)?|der", "remove": "que|que la", "price": "that|les", "action": "from",
            "complete": "in|en", "surprise": "was"}
CUES = {"price": "thre|ouan", "cash": "thre", "action": "elt", "detail": "ndl", "benefit": "rion", "complete": "ung", "surprise": "dos"}
# Accented letters count as letters at word edges; RE2 knows only ASCII ones, so they become x first.
PLAIN = "regexp_replace({0}, '[À-ɏ]', 'x', 'g')"


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(label, col="text"):
    return f"list_filter({_list(TERMS[label])}, lambda t: contains({col}, t))"


def _found(kind, col="text"):
    return f"regexp_extract_all({PLAIN.format(col)}, '(?i)\\b(?:{PATTERNS[kind]})\\b')"


def _has(kind, col="text"):
    return f"regexp_matches({PLAIN.format(col)}, '(?i)\\b(?:{PATTERNS[kind]})\\b')"


LABELS = f"""hits AS (SELECT *, list_concat({_hits('benefit')}, {_found('benefit')}) AS hb,
  list_concat({_hits('selling_point')}, {_found('selling_point')}) AS hs, list_concat({_hits('remove')}, {_found('remove')}) AS hr FROM captions),
labelled AS (SELECT *, CASE WHEN len(hr) > 0 AND len(hb) = 0 AND len(hs) = 0 THEN 'remove' WHEN len(hb) > 0 THEN 'benefit'
    WHEN len(hs) > 0 THEN 'selling_point' ELSE 'other' END AS label,
  CASE WHEN len(hr) > 0 AND len(hb) = 0 AND len(hs) = 0 THEN least(0.96::DOUBLE, 0.78::DOUBLE + 0.02::DOUBLE * len(hr))
    WHEN len(hb) > 0 THEN least(0.96::DOUBLE, 0.72::DOUBLE + 0.04::DOUBLE * len(hb))
    WHEN len(hs) > 0 THEN least(0.94::DOUBLE, 0.68::DOUBLE + 0.04::DOUBLE * len(hs)) ELSE 0.42::DOUBLE END AS score,
  CASE WHEN len(hr) > 0 AND len(hb) = 0 AND len(hs) = 0 THEN hr[1:4] WHEN len(hb) > 0 THEN list_concat(hb, hs)[1:4] ELSE hs[1:4] END AS words FROM hits)"""


def labelled(spark, sf):
    return classify.classify(b.captions(spark, sf), TERMS, PATTERNS)


@check("normalize_text", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '<\|[^>]+\|>', '', 'g'),
  '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), ' +', ' ', 'g'), ' +([，。！？；、,.!?;:])', '\1', 'g')) AS digest FROM documents""")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@check("clean_token", r"""SELECT doc_id, md5(regexp_replace(translate(regexp_replace(text, '<\|[^>]+\|>', '', 'g'), '▁Ġ', '  '),
  '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS digest FROM documents""")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.md5(text.clean_token(F.col("text"))).alias("digest"))


@check("content_chars", """SELECT doc_id, md5(regexp_replace(text, '[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]', '', 'g')) AS digest FROM documents""")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.md5(text.content_chars(F.col("text"))).alias("digest"))


@check("text_limit", """SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}\\x{3040}-\\x{30ff}]'))
  THEN 42 ELSE 13 END AS char_limit FROM documents""")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.text_limit(F.col("text")).alias("char_limit"))


@check("signals", "SELECT doc_id, " + ", ".join(f"array_to_string({_found(k)}, '|') AS {k}" for k in PATTERNS) + " FROM documents")
def _(spark, sf):
    found = b.table(spark, sf, "documents").select("doc_id", text.signals(F.col("text"), PATTERNS).alias("s"))
    return found.select("doc_id", *[F.array_join(F.col("s")[k], "|").alias(k) for k in PATTERNS])


@check("lexicon_hits", f"SELECT doc_id, array_to_string({_hits('selling_point')}, '|') AS terms FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(text.lexicon_hits(F.col("text"), TERMS["selling_point"]), "|").alias("terms"))


def lexicon(spark, sf):
    """Lexicon of brand words: every product name's words, numbered, under its type."""
    words = b.table(spark, sf, "part").select(F.col("p_type").alias("label"), F.explode(F.split("p_name", " ")).alias("word"))
    words = words.select("label", F.substring("word", 1, 3).alias("term")).distinct()
    return words.select("label", "term", F.ascii("term").alias("ord"))


@check("lexicon_join", b.with_sql("captions") + """, lex AS (SELECT DISTINCT p_type AS label, unnest(string_split(p_name, ' '))[1:3] AS term FROM part)
SELECT video_id, id, label, string_agg(term, '|' ORDER BY ascii(term), term) AS terms FROM captions JOIN lex ON contains(text, term) GROUP BY ALL""")
def _(spark, sf):
    found = classify.lexicon_join(b.captions(spark, sf), lexicon(spark, sf))
    return found.select("video_id", "id", "label", F.array_join("terms", "|").alias("terms"))


@check("lexicon_join_words", b.with_sql("captions") + """, lex AS (SELECT 'said' AS label, word AS term, count(*) AS ord FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) WHERE length(word) >= 4 GROUP BY word
  UNION ALL SELECT DISTINCT 'product', unnest(string_split(p_name, ' ')), 1 FROM part)
SELECT video_id, id, label, md5(string_agg(term, '|' ORDER BY ord, term)) AS terms FROM captions JOIN lex ON contains(text, term) GROUP BY ALL""")
def _(spark, sf):
    """Whole words as terms: those of product names and all longer ones that were ever said."""
    word = F.explode(F.split("text", " ")).alias("term")
    said = b.table(spark, sf, "conversations").select(word).filter(F.length("term") >= 4).groupBy("term").agg(F.count(F.lit(1)).alias("ord"))
    made = b.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct().withColumn("ord", F.lit(1).cast("bigint"))
    lex = said.withColumn("label", F.lit("said")).unionByName(made.withColumn("label", F.lit("product")))
    return classify.lexicon_join(b.captions(spark, sf), lex).select("video_id", "id", "label", F.md5(F.array_join("terms", "|").cast("binary")).alias("terms"))


@check("classify", b.with_sql("captions") + f", {LABELS} SELECT video_id, id, label, round(score, 4) AS score, array_to_string(words, '|') AS words FROM labelled")
def _(spark, sf):
    return labelled(spark, sf).select("video_id", "id", "label", F.round("score", 4).alias("score"), F.array_join("highlight_words", "|").alias("words"))


EFFECT = f"""CASE WHEN {_has('price')} OR regexp_matches(text, '{CUES['price']}') THEN CASE WHEN regexp_matches(text, '{CUES['cash']}') THEN 'cash' ELSE 'coin' END
  WHEN {_has('action')} OR regexp_matches(text, '{CUES['action']}') THEN 'click'
  WHEN {_has('selling_point')} OR regexp_matches(text, '{CUES['detail']}') THEN 'chime'
  WHEN {_has('benefit')} OR regexp_matches(text, '{CUES['benefit']}') THEN CASE WHEN index % 2 = 0 THEN 'shine' ELSE 'ding' END
  WHEN {_has('complete')} OR regexp_matches(text, '{CUES['complete']}') THEN 'success'
  WHEN {_has('surprise')} OR regexp_matches(text, '{CUES['surprise']}') THEN 'surprise'
  WHEN label = 'selling_point' THEN CASE WHEN index % 2 = 0 THEN 'shine' ELSE 'chime' END
  WHEN label = 'benefit' THEN CASE WHEN index % 2 = 0 THEN 'pop' ELSE 'ding' END
  ELSE ['pop', 'snap', 'tap', 'bounce'][index % 4 + 1] END"""


@check("assign_effect", b.with_sql("captions") + f", {LABELS} SELECT video_id, id, {EFFECT} AS type FROM (SELECT *, id AS index FROM labelled)")
def _(spark, sf):
    return classify.assign_effect(labelled(spark, sf).withColumn("index", F.col("id")), PATTERNS, CUES).select("video_id", "id", "type")


@check("hook_end", b.with_sql("captions") + f""", {LABELS}, firsts AS (SELECT video_id, arg_min(end_ms, id) AS e FROM labelled
  WHERE label IN ('benefit', 'selling_point') AND end_ms - start_ms BETWEEN 3000 AND 10000 GROUP BY video_id)
SELECT video_id, CASE WHEN e IS NULL THEN 8000 ELSE greatest(3000, least(10000, e)) END AS hook_end_ms FROM (SELECT DISTINCT video_id FROM captions) LEFT JOIN firsts USING (video_id)""")
def _(spark, sf):
    return classify.hook_end(labelled(spark, sf))


@check("pack_batches", b.with_sql("captions") + """, n AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY id) - 1) // 3 AS batch FROM captions)
SELECT video_id, batch, count(*) AS n_items, '[' || string_agg('{"id":' || id || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY id) || ']' AS payload FROM n GROUP BY ALL""")
def _(spark, sf):
    return classify.pack_batches(b.captions(spark, sf), 3).withColumn("n_items", F.col("n_items").cast("bigint"))


# ---- model replies, made from the captions themselves: some shorter, some relabelled, some missing

REPLIES = """replies AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS id, turn * 2 AS seq,
  CASE WHEN role = 'user' THEN 'Re ' || text WHEN length(text) > 400 THEN text[1:100] ELSE text || ' elle' END AS text,
  CASE WHEN role = 'user' THEN 'benefit' WHEN length(text) > 300 THEN 'unknown' ELSE 'remove' END AS label,
  length(text) // 10 / 100.0::DOUBLE AS score, [text[1:5], 'zzz', text[3:6]] AS words FROM conversations WHERE role <> 'system'
  UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, turn * 2 + 1, text, 'other', 0.9::DOUBLE, [text[1:4]] FROM conversations WHERE length(text) < 250)"""


def replies(spark, sf):
    said = b.table(spark, sf, "conversations").withColumn("video_id", F.col("conv_id").cast("string"))
    n = F.length("text")
    first = said.filter("role <> 'system'").select(
        "video_id", F.col("turn").alias("id"), (F.col("turn") * 2).alias("seq"),
        F.when(F.col("role") == "user", F.concat(F.lit("Re "), "text")).when(n > 400, F.substring("text", 1, 100)).otherwise(F.concat("text", F.lit(" elle"))).alias("text"),
        F.when(F.col("role") == "user", "benefit").when(n > 300, "unknown").otherwise("remove").alias("label"), (F.floor(n / 10) / 100.0).alias("score"),
        F.array(F.substring("text", 1, 5), F.lit("zzz"), F.substring("text", 3, 4)).alias("highlight_words"), F.lit("model").alias("reason"))
    second = said.filter(n < 250).select(
        "video_id", F.col("turn").alias("id"), (F.col("turn") * 2 + 1).alias("seq"), "text", F.lit("other").alias("label"), F.lit(0.9).alias("score"),
        F.array(F.substring("text", 1, 4)).alias("highlight_words"), F.lit("model").alias("reason"))
    return first.unionByName(second)


RECONCILED = b.with_sql("captions") + f""", {REPLIES}, latest AS (SELECT video_id, id, arg_max(struct_pack(t := text, l := label, s := score, w := words), seq) AS m FROM replies GROUP BY ALL),
answered AS (SELECT DISTINCT video_id, true AS answered FROM latest),
offered AS (SELECT c.video_id, c.id, c.text AS original, m, answered, trim(coalesce(m.t, '')) AS o FROM captions c LEFT JOIN latest USING (video_id, id) LEFT JOIN answered USING (video_id)),
said AS (SELECT *, CASE WHEN m IS NULL OR o = '' OR length(o) < greatest(2.0, length(original) * 0.55) THEN original ELSE o END AS text FROM offered),
base AS (SELECT * FROM said)""" + ", " + LABELS.replace("FROM captions", "FROM base") + """,
judged AS (SELECT *, CASE WHEN m.l = 'benefit' AND NOT regexp_matches(text, '[A-Za-z]') AND len(hb) = 0 THEN 'other' ELSE coalesce(m.l, 'other') END AS ml,
  list_filter(coalesce(m.w, []), lambda w: w <> '' AND contains(text, w))[1:4] AS mw, CASE WHEN m IS NULL THEN 0.42::DOUBLE ELSE m.s END AS ms FROM labelled),
final AS (SELECT video_id, id, text, CASE WHEN label <> 'other' OR answered IS NULL THEN label WHEN ml = 'unknown' THEN 'other' ELSE ml END AS label,
  CASE WHEN answered IS NULL THEN score ELSE round(greatest(score, CASE WHEN label <> 'other' OR ml <> 'unknown' THEN ms ELSE 0 END), 2) END AS score,
  CASE WHEN answered IS NULL THEN words WHEN label <> 'other' THEN list_concat(words, mw) ELSE mw END AS words FROM judged)"""


@check("reconcile_model", RECONCILED + " SELECT video_id, id, md5(text) AS digest, label, round(score, 4) AS score FROM final")
def _(spark, sf):
    rows = model.reconcile_model(b.captions(spark, sf), replies(spark, sf), lexicon=TERMS, patterns=PATTERNS, ratio_guard=False)
    return rows.select("video_id", "id", F.md5("text").alias("digest"), "label", F.round("score", 4).alias("score"))


@check("reconcile_words", RECONCILED + """, opened AS (SELECT video_id, id, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM final),
firsts AS (SELECT video_id, id, w, min(k) AS k FROM opened GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, id ORDER BY k) AS r FROM firsts)
SELECT video_id, id, string_agg(w, '|' ORDER BY r) AS words FROM ranked WHERE r <= 4 GROUP BY ALL""")
def _(spark, sf):
    rows = model.reconcile_model(b.captions(spark, sf), replies(spark, sf), lexicon=TERMS, patterns=PATTERNS, ratio_guard=False)
    return rows.filter(F.size("highlight_words") > 0).select("video_id", "id", F.array_join("highlight_words", "|").alias("words"))


@check("reconcile_model_guarded")
def _(spark, sf):
    return model.reconcile_model(b.captions(spark, sf), replies(spark, sf), lexicon=TERMS, patterns=PATTERNS).select("video_id", "id", "label", "text")


@check("rule_path", b.with_sql("captions") + f", {LABELS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS id, start_ms, end_ms, label, true AS timestamp_locked FROM labelled")
def _(spark, sf):
    return model.rule_path(b.captions(spark, sf), lexicon=TERMS, patterns=PATTERNS).select("video_id", "id", "start_ms", "end_ms", "label", "timestamp_locked")


@check("parse_responses", """SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS batch, 0 AS at, turn AS id, text, role AS label FROM conversations""")
def _(spark, sf):
    said = b.table(spark, sf, "conversations")
    item = F.to_json(F.array(F.struct(F.col("turn").alias("id"), "text", F.col("role").alias("label"))))
    raw = said.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("batch"), F.concat(F.lit("ok {]: "), item, F.lit(" done [")).alias("raw"))
    return model.parse_responses(raw).select("video_id", "batch", F.col("seq.at").alias("at"), "id", "text", "label")


@check("parse_responses_odd", """SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS batch, k AS at, turn + CASE WHEN k = 5 THEN 1 ELSE 0 END AS id, text,
  CASE WHEN k = 1 THEN 0.9::DOUBLE WHEN k = 3 THEN 0.25::DOUBLE END AS score FROM conversations, (SELECT unnest([1, 3, 5]) AS k) WHERE turn % 3 <> 2""")
def _(spark, sf):
    """Ids and scores as text or fractions, and elements that are none, in a list or under ``items``; every third reply is prose."""
    said = b.table(spark, sf, "conversations")
    own, text = F.col("turn").cast("string"), F.to_json(F.struct("text"))
    fields = F.substring(text, F.lit(2), F.length(text))
    items = F.concat(F.lit('["junk", {"id":"'), own, F.lit('","score":"0.9",'), fields, F.lit(', {"score":1}, {"id":'), own, F.lit('.0,"score":0.25,'), fields,
                     F.lit(', 7, {"id":'), (F.col("turn") + 1).cast("string"), F.lit(',"score":"high",'), fields, F.lit(', {"id":"none",'), fields, F.lit("]"))
    raw = F.when(F.col("turn") % 3 == 0, items).when(F.col("turn") % 3 == 1, F.concat(F.lit('Here: {"items":'), items, F.lit("}"))).otherwise(F.lit("I can't."))
    rows = model.parse_responses(said.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("batch"), raw.alias("raw")))
    return rows.select("video_id", "batch", F.col("seq.at").alias("at"), "id", "text", "score")


@check("unusable_batches", "SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS batch FROM conversations WHERE turn % 3 <> 0")
def _(spark, sf):
    said = b.table(spark, sf, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ok ["), F.to_json(F.struct("text")), F.lit("]"))).when(F.col("turn") % 3 == 1, F.to_json(F.struct("text")))
    return model.unusable_batches(said.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("batch"), raw.alias("raw")))


BATCHED = RECONCILED.replace("FROM replies GROUP BY ALL", """FROM replies JOIN (SELECT video_id, id, (row_number() OVER (PARTITION BY video_id ORDER BY id) - 1) // 3 AS own FROM captions) USING (video_id, id)
  WHERE own = own + CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END AND video_id NOT IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id % 5 = 0) GROUP BY video_id, id""")


@check("reconcile_model_batches", BATCHED + " SELECT video_id, id, md5(text) AS digest, label, round(score, 4) AS score FROM final")
def _(spark, sf):
    """Every fourth reply comes in the batch after its own; some videos have a batch without a list."""
    rows = b.captions(spark, sf)
    own = model.ordered(rows.select("video_id", "id"), ["video_id"], ["id"], model.by_position("id"), number="_n")
    own = own.select("video_id", "id", (F.floor(F.col("_n") / 3) + F.when(F.col("id") % 4 == 1, 1).otherwise(0)).alias("batch"))
    unusable = b.table(spark, sf, "conversations").filter("conv_id % 5 = 0").select(F.col("conv_id").cast("string").alias("video_id"), F.lit(0).alias("batch"))
    out = model.reconcile_model(rows, replies(spark, sf).join(own, ["video_id", "id"]), lexicon=TERMS, patterns=PATTERNS, ratio_guard=False, batch_size=3, unusable=unusable)
    return out.select("video_id", "id", F.md5("text").alias("digest"), "label", F.round("score", 4).alias("score"))


# ---- product names in captions

LETTERS = "a-z"


def products(spark, sf):
    """The product of a conversation is the name of the part with its number."""
    return b.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("product_name"))


SLIPS = b.with_sql("captions") + """, names AS (SELECT CAST(p_partkey AS VARCHAR) AS video_id, regexp_replace(p_name, '[^a-z]', '', 'g') AS p FROM part),
widths AS (SELECT *, unnest(range(3, least(6, length(p)) + 1)) AS width FROM names WHERE length(p) >= 3),
places AS (SELECT *, unnest(range(1, length(p) - width + 2)) AS i FROM widths),
targets AS (SELECT DISTINCT video_id, width, p[i:i + width - 1] AS target, p[i:i + width - 1] = p[1:3] AS is_brand FROM places),
spots AS (SELECT c.video_id, c.id, c.text, w.width, unnest(range(1, length(c.text) - w.width + 2)) AS position FROM captions c JOIN widths w USING (video_id)),
said AS (SELECT video_id, id, width, position, text[position:position + width - 1] AS source FROM spots),
slips AS (SELECT video_id, id, position, width, source, target, is_brand FROM said JOIN targets USING (video_id, width)
  WHERE regexp_full_match(source, '[a-z]+') AND hamming(source, target) = 1)"""


@check("name_slips", SLIPS + " SELECT video_id, id, position, width, source, target, is_brand FROM slips")
def _(spark, sf):
    rows = names.name_slips(b.captions(spark, sf), products(spark, sf), LETTERS, ())
    return rows.select("video_id", "id", F.col("position").cast("bigint").alias("position"), F.col("width").cast("bigint").alias("width"), "source", "target", "is_brand")


# Brand slips are all three wide: taken left to right, skipping those that overlap the last one taken.
CORRECTED = SLIPS.replace("WITH ", "WITH RECURSIVE ", 1) + """, brand AS (SELECT video_id, id, position, min(target) AS target, min(source) AS source FROM slips WHERE is_brand GROUP BY ALL),
picked AS (SELECT video_id, id, min(position) AS position FROM brand GROUP BY ALL
  UNION ALL SELECT p.video_id, p.id, (SELECT min(b.position) FROM brand b WHERE b.video_id = p.video_id AND b.id = p.id AND b.position >= p.position + 3)
  FROM picked p WHERE p.position IS NOT NULL),
changes AS (SELECT b.* FROM picked JOIN brand b USING (video_id, id, position))"""


@check("correction_log", CORRECTED + """ SELECT video_id, id, row_number() OVER (PARTITION BY video_id, id ORDER BY position DESC) - 1 AS change,
  source AS "from", target AS "to" FROM changes""")
def _(spark, sf):
    rows = names.correction_log(names.correct_names(b.captions(spark, sf), products(spark, sf), letters=LETTERS, generic=()))
    return rows.select("video_id", "id", F.col("change").cast("bigint").alias("change"), "from", "to")


@check("correct_names", CORRECTED + """, cuts AS (SELECT video_id, id, position AS s, position + 3 AS nxt, target FROM changes UNION ALL SELECT video_id, id, -2, 1, '' FROM captions),
parts AS (SELECT c.video_id, c.id, s, target || text[nxt:coalesce(lead(s) OVER (PARTITION BY c.video_id, c.id ORDER BY s), length(text) + 1) - 1] AS part FROM cuts c JOIN captions USING (video_id, id))
SELECT video_id, id, md5(string_agg(part, '' ORDER BY s)) AS digest FROM parts GROUP BY ALL""")
def _(spark, sf):
    rows = names.correct_names(b.captions(spark, sf), products(spark, sf), letters=LETTERS, generic=())
    return rows.select("video_id", "id", F.md5("text").alias("digest"))


# Two letters spell the sound of a letter; two such sounds are alike when they share a letter.
SOUND = "substr('abcdefg', ascii({0}) % 7 + 1, 1) || substr('hijkl', ascii({0}) % 5 + 1, 1)"
HEARD = SLIPS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", spelled AS (SELECT *, list_filter(range(1, width + 1), lambda k: source[k] <> target[k])[1] AS d FROM slips),
voiced AS (SELECT *, {SOUND.format('source[d]')} AS x, {SOUND.format('target[d]')} AS y FROM spelled),
ok AS (SELECT video_id, id, position, width, target, source, row_number() OVER (PARTITION BY video_id, id ORDER BY width DESC, position, target, source) AS k FROM voiced WHERE is_brand OR x[1] = y[1] OR x[2] = y[2]),
listed AS (SELECT video_id, id, list(struct_pack(p := position, w := width, t := target, s := source) ORDER BY k) AS found FROM ok GROUP BY ALL),
fold AS (SELECT video_id, id, found, 1 AS k, found[1:1] AS taken FROM listed
  UNION ALL SELECT video_id, id, found, k + 1, CASE WHEN len(list_filter(taken, lambda t: t.p < found[k + 1].p + found[k + 1].w AND found[k + 1].p < t.p + t.w)) > 0 THEN taken ELSE list_append(taken, found[k + 1]) END
  FROM fold WHERE k < len(found)),
heard AS (SELECT video_id, id, unnest(taken) AS c FROM fold WHERE k = len(found))"""


def _sounds(spark):
    letters = [chr(c) for c in range(97, 123)]
    return spark.createDataFrame([(c, "abcdefg"[ord(c) % 7] + "hijkl"[ord(c) % 5]) for c in letters], "char string, sound string")


@check("correct_names_sounds", HEARD + """ SELECT video_id, id, c.w AS width, c.s AS "from", c.t AS "to", row_number() OVER (PARTITION BY video_id, id ORDER BY c.p DESC) - 1 AS change FROM heard""")
def _(spark, sf):
    """Names of all widths, longest first, where letters sound alike."""
    rows = names.correct_names(b.captions(spark, sf), products(spark, sf), _sounds(spark), LETTERS, ())
    return names.correction_log(rows).select("video_id", "id", F.length("from").cast("bigint").alias("width"), "from", "to", F.col("change").cast("bigint").alias("change"))


# ---- captions from text and characters

A, MARK = "[A-Za-z0-9]", "，。！？；,!?;."
SPLIT = b.with_sql("captions").replace("WITH ", "WITH RECURSIVE ", 1) + f""", clean AS (SELECT video_id, id AS seg_id,
  trim(regexp_replace(trim(regexp_replace(regexp_replace(text, '<\\|[^>]+\\|>', '', 'g'), '\\s+', ' ', 'g')), ' +([，。！？；、,.!?;:])', '\\1', 'g'), '，。！？；,.!?; ') AS t FROM captions WHERE end_ms > start_ms),
sized AS (SELECT *, CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) > len(regexp_extract_all(t, '[㐀-鿿぀-ヿ]')) THEN 42 ELSE 13 END AS size FROM clean WHERE t <> ''),
opened AS (SELECT video_id, seg_id, size, unnest(c) AS clause, generate_subscripts(c, 1) AS k FROM (SELECT *,
  regexp_extract_all(regexp_replace(t, '\\.([0-9])', chr(1) || '\\1', 'g'), '[^{MARK}]*[{MARK}]|[^{MARK}]+$') AS c FROM sized)),
walk AS (SELECT video_id, seg_id, k, size, 0 AS n, trim(replace(clause, chr(1), '.')) AS rest, CAST(NULL AS VARCHAR) AS piece FROM opened
  UNION ALL SELECT video_id, seg_id, k, size, n + 1, substr(rest, cut + 1), CASE WHEN length(rest) > size THEN trim(rest[1:cut], '，；、 ') WHEN trim(rest, '，。！？；,.!?; ') <> '' THEN trim(rest) END
  FROM (SELECT *, CASE WHEN length(rest) <= size THEN length(rest) WHEN mark >= 4 THEN mark ELSE size + word + CASE WHEN regexp_matches(rest[size + word], '[\\p{{L}}\\p{{N}}]')
      THEN length(regexp_extract(substr(rest, size + word + 1), '^[\\p{{L}}\\p{{N}}]+')) ELSE 0 END END AS cut
    FROM (SELECT *, length(regexp_extract(rest[1:size + 1], '^.*[，；、]')) AS mark,
      CASE WHEN regexp_matches(rest[size - 1:size + 2], '^.({A}({A}|[''’-]{A}|\\.[0-9]))') OR regexp_matches(rest[size - 1:size + 1], '^({A}[''’-]{A}|{A}\\.[0-9])')
        THEN length(regexp_extract(substr(rest, size + 1), '^[''’.-]?{A}*(?:[''’-]{A}+|\\.[0-9]+)*')) ELSE 0 END AS word FROM walk WHERE rest <> ''))),
pieces AS (SELECT video_id, seg_id, CAST(row_number() OVER (PARTITION BY video_id, seg_id ORDER BY k, n) - 1 AS INTEGER) AS piece, piece AS text FROM walk WHERE piece IS NOT NULL)
SELECT video_id, seg_id, piece, text FROM pieces"""


@check("split_text", SPLIT)
def _(spark, sf):
    rows = b.captions(spark, sf).select("video_id", F.col("id").alias("seg_id"), "text", "start_ms", "end_ms")
    return captions.split_text(rows).select("video_id", "seg_id", "piece", "text")


@check("estimated_captions")
def split_rows(spark, sf):
    rows = b.captions(spark, sf).select("video_id", F.col("id").alias("seg_id"), "text", "start_ms", "end_ms")
    return captions.estimated_captions(rows)


@check("split_text_tiles", """WITH texts AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seg_id, text FROM conversations)
SELECT video_id, seg_id, 60 * length(text) AS covered_ms, 0 AS gaps, md5(regexp_replace(text, '[，。！？；、,.!?; \\n\\r\\t]', '', 'g')) AS letters FROM texts
WHERE regexp_replace(text, '[，。！？；、,.!?; \\n\\r\\t]', '', 'g') <> ''""")
def _(spark, sf):
    """Every letter of a turn is kept, in order, and its pieces tile its time."""
    rows = split_rows(spark, sf)
    rows = ordered(rows, ["video_id", "seg_id"], ["piece"], by_position("piece"), lag={"prev_end": F.col("end_ms")})
    letters = F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), ""),
                               "[，。！？；、,.!?; \\n\\r\\t]", "")
    return rows.groupBy("video_id", "seg_id").agg(
        (F.max("end_ms") - F.min("start_ms")).alias("covered_ms"),
        F.count_if(F.col("prev_end") != F.col("start_ms")).cast("int").alias("gaps"), F.md5(letters).alias("letters"))


@check("strip_marks", """WITH runs AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, unnest(r) AS mark, generate_subscripts(r, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]+|[^，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]+') AS r FROM documents)),
placed AS (SELECT *, regexp_matches(mark, '^[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]') AS is_mark FROM runs),
summed AS (SELECT *, CAST(coalesce(sum(CASE WHEN is_mark THEN 0 ELSE length(mark) END) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM placed)
SELECT video_id, pos, mark FROM summed WHERE is_mark""")
def _(spark, sf):
    return captions.strip_marks(b.documents(spark, sf).withColumn("seg_id", F.lit(0).cast("bigint"))).drop("seg_id")


def chars_of(spark, sf):
    """Conversation turns as timed characters: 80 ms each, a pause of half a second after line ends."""
    rows = b.captions(spark, sf)
    content = F.filter(F.split(text.content_chars(F.regexp_replace("text", "\\n", "—")), ""), lambda c: c != "")
    chars = rows.select("video_id", F.col("id").alias("seg_id"), "start_ms", F.posexplode(content).alias("pos", "text"))
    at = F.col("start_ms") + F.col("pos") * 55 + F.floor(F.col("pos") / 97) * 500
    chars = chars.select("video_id", "seg_id", F.col("pos").cast("bigint").alias("pos"), "text", at.alias("start_ms"), (at + 55).alias("end_ms"), F.lit("").alias("prefix"))
    texts = rows.select("video_id", F.col("id").alias("seg_id"), F.regexp_replace("text", "\\n", "—").alias("text"), "start_ms",
                        (F.col("end_ms") + 60_000).alias("end_ms"))
    return chars, texts


PUNCT = """[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]"""
SEGMENTED = b.with_sql("captions").replace("WITH ", "WITH RECURSIVE ", 1) + f""", src AS (SELECT *, CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) > len(regexp_extract_all(t, '[㐀-鿿぀-ヿ]')) THEN 42 ELSE 13 END AS size
  FROM (SELECT video_id, id AS seg_id, replace(text, chr(10), '—') AS t, start_ms AS ss, end_ms + 60000 AS se FROM captions)),
kept AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_id ORDER BY op) - 1 AS pos FROM (SELECT *, t[op:op] AS ch FROM (SELECT *, unnest(range(1, length(t) + 1)) AS op FROM src)) WHERE NOT regexp_matches(ch, '{PUNCT}')),
timed AS (SELECT *, ss + pos * 55 + pos // 97 * 500 AS s, ss + pos * 55 + pos // 97 * 500 + 55 AS e FROM kept),
near AS (SELECT *, lead(op) OVER w AS nop, lead(ch) OVER w AS nch, lead(s) OVER w AS ns FROM timed WINDOW w AS (PARTITION BY video_id, seg_id ORDER BY pos)),
marked AS (SELECT *, nop IS NULL AS last, CASE WHEN nop IS NULL THEN substr(t, op + 1) ELSE t[op + 1:nop - 1] END AS mark FROM near),
c AS MATERIALIZED (SELECT *, last OR NOT (regexp_matches(ch || nch, '^[\\p{{L}}\\p{{N}}]{{2}}') AND (mark IN ('', '''', '’', '-') OR (mark = '.' AND regexp_matches(ch || nch, '^[0-9]{{2}}')))) AS edge,
  last OR regexp_matches(mark, '[，。！？；,.!?;]') OR ns - e >= 380 AS stop FROM marked),
walk AS (SELECT video_id, seg_id, pos, 0 AS piece, 1 AS n, s AS began, edge AND (1 >= size OR last) AS broken FROM c WHERE pos = 0
  UNION ALL SELECT video_id, seg_id, pos, piece, n, began, edge AND (n >= size OR last OR (n >= 2 AND (stop OR e - began >= 4200))) FROM (
    SELECT c.video_id, c.seg_id, c.pos, c.size, c.last, c.stop, c.edge, c.e, w.piece + CASE WHEN w.broken THEN 1 ELSE 0 END AS piece,
      CASE WHEN w.broken THEN 1 ELSE w.n + 1 END AS n, CASE WHEN w.broken THEN c.s ELSE w.began END AS began
    FROM walk w JOIN c ON c.video_id = w.video_id AND c.seg_id = w.seg_id AND c.pos = w.pos + 1)),
spans AS (SELECT video_id, seg_id, piece, any_value(t) AS t, any_value(ss) AS ss, any_value(se) AS se, any_value(size) AS size, min(pos) AS p, min(op) AS a, arg_max(struct_pack(z := nop), pos).z AS z, min(s) AS s, max(e) AS e,
  arg_max(struct_pack(n := ns), pos).n AS ns FROM walk JOIN c USING (video_id, seg_id, pos) GROUP BY video_id, seg_id, piece),
said AS (SELECT video_id, seg_id, piece, size, trim(t[CASE WHEN p = 0 THEN 1 ELSE a END:coalesce(z - 1, length(t))]) AS text, greatest(ss, s - 30) AS start_ms,
  least(se, greatest(greatest(ss, s - 30) + 60, least(se, e + 120, coalesce(ns - 30, se)))) AS end_ms FROM spans),
tails AS (SELECT *, count(*) OVER (PARTITION BY video_id, seg_id) AS k, lag(length(text)) OVER o AS pl, lead(text) OVER o AS tail, lead(end_ms) OVER o AS tail_end FROM said WINDOW o AS (PARTITION BY video_id, seg_id ORDER BY piece)),
lone AS (SELECT *, piece = k - 2 AND length(regexp_replace(tail, '{PUNCT}', '', 'g')) <= 1 AND length(text) + length(tail) <= size + 3 AS takes,
  piece = k - 1 AND k > 1 AND length(regexp_replace(text, '{PUNCT}', '', 'g')) <= 1 AND pl + length(text) <= size + 3 AS goes FROM tails)
SELECT video_id, seg_id, CAST(piece AS BIGINT) AS piece, CASE WHEN takes THEN text || CASE WHEN regexp_matches(text[-1:] || tail[1:1], '[A-Za-z]') THEN ' ' ELSE '' END || tail ELSE text END AS text,
  start_ms, CASE WHEN takes THEN tail_end ELSE end_ms END AS end_ms, 'sensevoice_token' AS timestamp_source FROM lone WHERE NOT coalesce(goes, false)"""


@check("segment_captions", SEGMENTED)
def segmented(spark, sf):
    chars, texts = chars_of(spark, sf)
    return captions.segment_captions(chars, texts)


@check("segment_captions_text", """SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seg_id,
  md5(regexp_replace(text, '[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— \\n-]', '', 'g')) AS letters FROM conversations""")
def _(spark, sf):
    """Segmenting keeps every content character in order."""
    rows = segmented(spark, sf)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "")
    return rows.groupBy("video_id", "seg_id").agg(F.md5(text.content_chars(whole)).alias("letters"))


@check("gap_captions", b.with_sql("intervals") + """, f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w < 3600000 THEN 0 ELSE 1 END AS o FROM intervals
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, id)),
g AS (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY start_ms, id) - 1 AS piece FROM f)
SELECT video_id, CAST(piece AS BIGINT) AS piece, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_tokens FROM g GROUP BY video_id, piece""")
def _(spark, sf):
    return captions.gap_captions(b.intervals(spark, sf), 3_600_000, span_ms=DAY)


@check("merge_short_tail", """WITH lines AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seg_id, unnest(string_split(text, '.')) AS text,
  generate_subscripts(string_split(text, '.'), 1) - 1 AS piece FROM conversations),
w AS (SELECT *, count(*) OVER (PARTITION BY video_id, seg_id) AS n, lag(length(text)) OVER o AS pl, lead(text) OVER o AS tail FROM lines
  WINDOW o AS (PARTITION BY video_id, seg_id ORDER BY piece)),
x AS (SELECT *, length(regexp_replace(text, '[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]', '', 'g')) <= 1 AS lone,
  length(regexp_replace(tail, '[，。！？；、,.!?;:：…‘’“”"''（）()【】\\[\\]《》<>— -]', '', 'g')) <= 1 AS tlone FROM w)
SELECT video_id, seg_id, piece, CASE WHEN piece = n - 2 AND tlone AND length(text) + length(tail) <= 123
  THEN text || CASE WHEN regexp_matches(text[-1:] || tail[1:1], '[A-Za-z]') THEN ' ' ELSE '' END || tail ELSE text END AS text
FROM x WHERE NOT (piece = n - 1 AND n > 1 AND lone AND pl + length(text) <= 123)""")
def _(spark, sf):
    lines = b.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seg_id"), F.posexplode(F.split("text", "\\.", -1)).alias("piece", "text"))
    out = captions.merge_short_tail(lines.withColumn("end_ms", F.col("piece")), 120)
    return out.select("video_id", "seg_id", F.col("piece").cast("bigint").alias("piece"), "text")


# ---- names, colours, numbers

STEM = r"""regexp_replace(regexp_extract(url, '([^/\\]+)[/\\]*$', 1), '^(.+)\.[^.]+$', '\1')"""


@check("video_key", f"""WITH s AS (SELECT page_id, url, trim(regexp_replace({STEM}, '[<>:"/\\\\|?*]+', '_', 'g'), ' ._')[1:100] AS stem FROM pages)
SELECT page_id, CASE WHEN stem = '' THEN 'video' ELSE stem END AS stem, CASE WHEN stem = '' THEN 'video' ELSE stem END || '_' || sha1(lower(url))[1:10] AS video_key FROM s""")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", ids.safe_stem(F.col("url")).alias("stem"), ids.video_key(F.col("url")).alias("video_key"))


@check("product_from_name", r"""WITH n AS (SELECT page_id, '2024.5.1' || page_id || '_' || replace(substr(html, 50, 40), '/', '') || '_V2_x-1.mp4' AS path FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_extract(path, '([^/\\]+)[/\\]*$', 1), '^(.+)\.[^.]+$', '\1') AS s FROM n)
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
  '^\d{4}[.-]\d{1,2}[.-]\d{1,2}', ''), '^\d+_', ''), '_(功效|卖点)精剪.*$', ''), '(?i)_v\d+.*$', ''), '_插入实拍', ''), '_字幕版', ''), '_智能包装', ''), '-1', ''), '-2', ''), '-3', ''),
  '_ -（）()') AS product FROM s""")
def _(spark, sf):
    path = F.concat(F.lit("2024.5.1"), F.col("page_id"), F.lit("_"), F.replace(F.substring("html", 50, 40), F.lit("/"), F.lit("")), F.lit("_V2_x-1.mp4"))
    return b.table(spark, sf, "pages").select("page_id", ids.product_from_name(path).alias("product"))


@check("same_path", "SELECT page_id, lower(replace(url, '\\', '/')) = lower(replace(replace(upper(url), '/', '\\'), '\\', '/')) AS same FROM pages")
def _(spark, sf):
    other = F.translate(F.upper("url"), "/", "\\")
    return b.table(spark, sf, "pages").select("page_id", ids.same_path(F.col("url"), other).alias("same"))


@check("script_language", """SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]{2}') AND NOT regexp_matches(text, '[\\x{3400}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]')
  THEN 'en' ELSE lang END AS language, CASE WHEN lang = 'en' THEN 'en' END AS forced, NOT regexp_matches(text, '[A-Za-z\\x{ac00}-\\x{d7af}\\x{3040}-\\x{30ff}]') AND text <> '' AS punctuate FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return b.table(spark, sf, "documents").select("doc_id", text.script_language(t, F.concat(F.lit("<|"), F.col("lang"), F.lit("|>"))).alias("language"),
                                                  text.fallback_language(F.col("lang")).alias("forced"), text.wants_punctuation(t).alias("punctuate"))


@check("ass_time", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cs // 360000 || ':' || lpad(CAST(cs // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0')
  || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS stamp FROM (SELECT *, CAST(greatest(0, round_even((l_partkey * 4321 - l_suppkey) / 10.0, 0)) AS BIGINT) AS cs FROM lineitem)""")
def _(spark, sf):
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.ass_time(F.col("l_partkey") * 4321 - F.col("l_suppkey")).alias("stamp"))


@check("ass_color", """SELECT page_id, upper('&H00' || d[5:6] || d[3:4] || d[1:2]) AS color FROM (SELECT page_id, rpad(regexp_replace(substr(url, 1, 30), '[^0-9A-Fa-f]', '', 'g'), 6, 'F')[1:6] AS d FROM pages)""")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.ass_color(F.substring("url", 1, 30)).alias("color"))


@check("ass_escape", r"""SELECT page_id, md5(replace(replace(replace(replace(html, '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\N')) AS digest FROM pages""")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", F.md5(text.ass_escape(F.col("html"))).alias("digest"))


@check("highlight_markup", r"""SELECT doc_id, md5(replace(replace(text, 'tion', '{\c&HA}tion{\c&HN}'), 'que', '{\c&HA}que{\c&HN}')) AS digest FROM (
  SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\N') AS text FROM documents)""")
def _(spark, sf):
    words = F.array(F.lit("que "), F.lit("tion"), F.lit(" "), F.lit("que"))
    return b.table(spark, sf, "documents").select("doc_id", F.md5(text.highlight_markup(F.col("text"), words, F.lit("&HN"), F.lit("&HA"))).alias("digest"))


@check("marker_target", """SELECT o_orderkey, CAST(CASE WHEN d <= 0 THEN 0 WHEN d < 60000 THEN greatest(1, ceil(d / 6000.0)) WHEN d <= 75000 THEN 10 WHEN d <= 100000 THEN 12
  WHEN d <= 120000 THEN 14 ELSE ceil(d * 7 / 60000.0) END AS BIGINT) AS target FROM (SELECT o_orderkey, o_custkey * 211 - 300 AS d FROM orders)""")
def _(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", timing.marker_target(F.col("o_custkey") * 211 - 300).alias("target"))


@check("tempo_chain", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.01::DOUBLE, (3 * l_partkey + 1) / greatest(80, l_suppkey * 39 + 81)::DOUBLE) AS r FROM lineitem),
n AS (SELECT *, greatest(0, CAST(ceil(-log2(r)) AS BIGINT) - 1) AS lo, greatest(0, CAST(ceil(log2(r)) AS BIGINT) - 1) AS hi FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, lo + hi + 1 AS factors, round_even(r * pow(2, lo) / pow(2, hi), 6) AS rest FROM n""")
def _(spark, sf):
    chain = timing.tempo_chain(F.col("l_partkey") * 3 + 1, F.col("l_suppkey") * 39 + 81)
    rows = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", chain.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size("c").cast("bigint").alias("factors"), F.element_at("c", -1).alias("rest"))


@check("snap_to_frame", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 37 AS ms, CASE WHEN l_suppkey % 7 = 0 THEN 25 ELSE 30000 END AS num,
  CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 1001 END AS den FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (2 * ((2 * ms * num + 1000 * den) // (2000 * den)) * den * 1000 + num) // (2 * num) AS frame_ms FROM f""")
def _(spark, sf):
    plain = F.col("l_suppkey") % 7 == 0
    num, den = F.when(plain, 0).otherwise(30000), F.when(plain, 1).otherwise(1001)
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", timing.snap_to_frame(F.col("l_partkey") * 37, num, den).alias("frame_ms"))


@check("position_px", """SELECT p_partkey, CAST(round_even(1080 * least(100.0, greatest(0.0, p_size * 4.37 - 20)) / 100, 0) AS BIGINT) AS x,
  CAST(round_even(1920 * least(100.0, greatest(0.0, 100.0 - p_size * 10 * 100.0 / 1920)) / 100, 0) AS BIGINT) AS y FROM part""")
def _(spark, sf):
    y = timing.default_y_percent(F.col("p_size") * 10, F.lit(1920))
    return b.table(spark, sf, "part").select("p_partkey", timing.position_px(F.col("p_size") * 4.37 - 20, F.lit(1080)).alias("x"), timing.position_px(y, F.lit(1920)).alias("y"))


@check("incomplete_ending", """SELECT conv_id, turn, regexp_matches(regexp_replace(text, '[，。！？；,.!?; ]+$', ''), '(the|ing|eau)$') AS incomplete FROM conversations""")
def _(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", text.incomplete_ending(F.col("text"), ("the", "ing", "eau")).alias("incomplete"))


@check("word_continues", r"""SELECT doc_id, l, r, s, regexp_matches(l, '^[A-Za-z0-9]') AND regexp_matches(r, '^[A-Za-z0-9]') AND
  (s IN ('', '''', '’', '-') OR (s = '.' AND regexp_matches(l, '^[0-9]') AND regexp_matches(r, '^[0-9]'))) AS continues
FROM (SELECT doc_id, regexp_replace(text[3:3], '[^\x00-\x7f]', '?') AS l, regexp_replace(text[5:5], '[^\x00-\x7f]', '?') AS r, text[4:4] AS s FROM documents)""")
def _(spark, sf):
    ascii_char = lambda i: F.regexp_replace(F.substring("text", i, 1), "[^\\x00-\\x7f]", "?")
    rows = b.table(spark, sf, "documents").select("doc_id", ascii_char(3).alias("l"), ascii_char(5).alias("r"), F.substring("text", 4, 1).alias("s"))
    return rows.select("*", text.word_continues(F.col("l"), F.col("r"), F.col("s")).alias("continues"))


@check("text_ratio")
def _(spark, sf):
    rows = ordered(b.table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], by_position("turn"),
                   lag={"previous": F.col("text")})
    return rows.select("conv_id", "turn", text.text_ratio(F.col("text"), F.col("previous")).alias("ratio"))


@check("extract_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    raw = F.concat(F.lit("note [1, {"), F.col("props"), F.lit("] end {"))
    return b.table(spark, sf, "events").select("event_id", F.get_json_object(text.extract_json(raw), "$.k").cast("bigint").alias("k"))


@check("name_score", r"""SELECT page_id, round(len(list_intersect(q, n)) / len(q) + CASE WHEN contains(nk, qk) OR contains(qk, nk) THEN 1.0 ELSE 0.0 END, 6) AS score FROM (
  SELECT page_id, list_distinct(string_split(qk, '')) AS q, list_distinct(string_split(nk, '')) AS n, qk, nk FROM (SELECT page_id, 'tionexample' AS qk, regexp_replace(lower(url), '[^\p{L}\p{N}]', '', 'g') AS nk FROM pages))""")
def _(spark, sf):
    score = text.name_score(F.lit("tionexample"), text.highlight_key(F.col("url")))
    return b.table(spark, sf, "pages").select("page_id", F.round(score, 6).alias("score"))


@check("highlight_key", r"SELECT page_id, regexp_replace(lower(url), '[^\p{L}\p{N}]', '', 'g') AS name_key FROM pages")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.highlight_key(F.col("url")).alias("name_key"))
