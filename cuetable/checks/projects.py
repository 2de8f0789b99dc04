"""Project, asset, source and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetable import bindings as b
from cuetable.checks.review import LOG, log_columns
from cuetable.functions.ids import video_key
from cuetable.operators import assets, projects, review
from cuetable.plans.commits import committed
from cuetable.plans.folders import new_folder
from cuetable.sources import documents, media
from cuetable.streaming import streams

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# ---- hashes: trees of four rows a node, three levels

def _tree(source, key, number, text):
    """SQL for the tree hash of ``source`` rows."""
    return f"""l0 AS (SELECT {key}, {number} AS n, sha256({text}) AS h FROM {source}),
l1 AS (SELECT {key}, n // 4 AS n, sha256(string_agg(h, ',' ORDER BY n)) AS h FROM l0 GROUP BY {key}, n // 4),
l2 AS (SELECT {key}, n // 4 AS n, sha256(string_agg(h, ',' ORDER BY n)) AS h FROM l1 GROUP BY {key}, n // 4),
l3 AS (SELECT {key}, sha256(string_agg(h, ',' ORDER BY n)) AS digest FROM l2 GROUP BY {key})"""


@check("edit_key", b.with_sql("clips") + ", " + _tree("clips", "video_id", "ord", "src_start_ms || '-' || src_end_ms") + " SELECT video_id, digest[1:16] AS edit_key FROM l3")
def _(spark, sf):
    return projects.edit_key(b.clips(spark, sf), part=4)


@check("revision", b.with_sql("captions") + ", rows AS (SELECT video_id, 'subtitles' AS field, row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS n, "
       "CAST(to_json(struct_pack(end_ms := end_ms, id := id, start_ms := start_ms, text := text)) AS VARCHAR) AS t FROM captions "
       "UNION ALL SELECT DISTINCT video_id, 'settings', 0, '{\"font_size\":54}' FROM captions), " + _tree("rows", "video_id, field", "n", "t") +
       " SELECT video_id, sha256(string_agg(field || '=' || digest, ';' ORDER BY field)) AS revision FROM l3 GROUP BY video_id")
def _(spark, sf):
    rows = b.captions(spark, sf)
    settings = rows.select("video_id").distinct().withColumn("font_size", F.lit(54))
    return projects.revision({"subtitles": (rows, ["id"]), "settings": (settings, ["font_size"]), "draft": (rows, ["id"])}, part=4)


@check("render_projection", """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderstatus <> 'P' THEN '{"asr":{"quality":{"status":"' || o_orderpriority || '"}}}' END AS model_output, false AS has_speech FROM orders""")
def _(spark, sf):
    quality = F.struct(F.struct(F.col("o_orderpriority").alias("status")).alias("quality"), F.lit("trace").alias("raw"))
    docs = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("video_id"), F.array(F.col("o_custkey")).alias("speech_segments"),
        F.struct(F.when(F.col("o_orderstatus") != "P", quality).alias("asr"), F.lit("x").alias("analysis")).alias("model_output"))
    out = projects.render_projection(docs)
    return out.select("video_id", F.to_json("model_output").alias("model_output"), F.lit("speech_segments" in out.columns).alias("has_speech"))


@check("project_measures", """SELECT CAST(c_custkey AS VARCHAR) AS video_id, coalesce(n, 0) AS subtitle_count, CASE WHEN c_nationkey < 20 THEN 's' || c_nationkey ELSE '' END AS quality_status,
  c_nationkey > 10 AS has_analysis, coalesce(n, 0) > 0 OR c_nationkey > 10 AS ready FROM customer LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ON conv_id = c_custkey""")
def _(spark, sf):
    people = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), (F.col("c_nationkey") > 10).alias("has_model"), "c_nationkey")
    quality = people.filter("c_nationkey < 20").select("video_id", F.concat(F.lit("s"), "c_nationkey").alias("status"))
    return projects.project_measures(people, b.captions(spark, sf), quality)


@check("preferred_captions", b.with_sql("captions") + """ SELECT video_id, id, label FROM (SELECT video_id, id, 'analysed' AS label FROM captions WHERE video_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 9)
UNION ALL SELECT video_id, id, NULL FROM captions WHERE video_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 9))""")
def _(spark, sf):
    rows = b.captions(spark, sf)
    some = b.table(spark, sf, "customer").filter("c_nationkey < 9").select(F.col("c_custkey").cast("string").alias("video_id"))
    analysed = rows.join(some, "video_id", "left_semi").withColumn("label", F.lit("analysed"))
    return projects.preferred_captions(analysed, rows).select("video_id", "id", "label")


ASSEMBLED = b.with_sql("captions") + """, sizes AS (SELECT video_id, count(*) AS n FROM captions GROUP BY video_id),
media AS (SELECT CAST(c_custkey AS VARCHAR) AS video_id, c_name AS path, c_custkey * 700 AS d, CASE WHEN c_nationkey > 4 THEN 'l' || c_nationkey END AS language FROM customer),
hooks AS (SELECT video_id, arg_min(end_ms, id) FILTER (id % 3 = 1 AND end_ms - start_ms BETWEEN 3000 AND 10000) AS h FROM captions GROUP BY video_id),
parts AS (SELECT video_id, unnest(range(0, greatest(1, (coalesce(n, 0) + 2) // 3))) AS part, coalesce(n, 0) AS n, path, d, language, h FROM media LEFT JOIN sizes USING (video_id) LEFT JOIN hooks USING (video_id))
SELECT video_id, part, path, greatest(0, least(3, n - part * 3)) AS subtitles, CASE WHEN part = 0 AND n > 0 THEN 1 ELSE 0 END AS segments, 54 AS font_size,
  CAST(CASE WHEN h IS NULL THEN 8000 ELSE greatest(3000, least(10000, h)) END AS BIGINT) AS hook_end_ms, coalesce(language, 'auto') AS asr_language,
  CAST(CASE WHEN d <= 0 THEN 0 WHEN d < 60000 THEN greatest(1, ceil(d / 6000.0)) WHEN d <= 75000 THEN 10 WHEN d <= 100000 THEN 12 WHEN d <= 120000 THEN 14 ELSE ceil(d * 7 / 60000.0) END AS BIGINT) AS sfx_target_count FROM parts"""


def assembled(spark, sf):
    people = b.table(spark, sf, "customer").withColumn("video_id", F.col("c_custkey").cast("string"))
    made = people.select("video_id", F.col("c_name").alias("path"))
    heard = people.select("video_id", (F.col("c_custkey") * 700).alias("duration_ms"), F.when(F.col("c_nationkey") > 4, F.concat(F.lit("l"), "c_nationkey")).alias("language"))
    rows = b.captions(spark, sf)
    derived = projects.derived_settings(heard, rows.withColumn("label", F.when(F.col("id") % 3 == 1, "benefit").otherwise("other")))
    segments = rows.groupBy("video_id").agg(F.max("end_ms").alias("end_ms")).withColumn("seg_id", F.lit(0))
    known = made.select("video_id")
    return projects.assemble_projects(made, {"subtitles": (rows.join(known, "video_id", "left_semi"), ["id"]),
                                             "speech_segments": (segments.join(known, "video_id", "left_semi"), ["seg_id"])}, part_rows=3, derived=derived)


def _sizes(docs):
    return docs.select("video_id", "part", "path", F.size("subtitles").alias("subtitles"), F.size("speech_segments").alias("segments"),
                       *[F.col(f"settings.{c}").alias(c) for c in ("font_size", "hook_end_ms", "asr_language", "sfx_target_count")])


@check("assemble_projects", ASSEMBLED)
def _(spark, sf):
    return _sizes(assembled(spark, sf))


@check("write_read_projects", ASSEMBLED)
def _(spark, sf):
    """Documents written, half of them written again, and read back."""
    docs = assembled(spark, sf)
    folder = new_folder(spark, "documents")
    documents.write_projects(docs, folder, 40)
    documents.write_projects(docs.filter("path < 'Customer#000000700'"), folder, 40)
    return _sizes(documents.read_projects(spark, folder, docs.schema))


@check("project_relation", b.with_sql("captions") + " SELECT video_id, id, start_ms, end_ms, text FROM captions WHERE video_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def _(spark, sf):
    return documents.project_relation(assembled(spark, sf), "subtitles")


@check("append_snapshots", "SELECT CAST(doc_id AS VARCHAR) AS video_id, 'r' || n_chars // 1000 AS revision, lang FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'again', lang FROM documents WHERE lang = 'fr'")
def _(spark, sf):
    """Two saves; only documents in French changed before the second."""
    folder = new_folder(spark, "snapshots")
    rows = b.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.concat(F.lit("r"), F.floor(F.col("n_chars") / 1000)).alias("revision"), "lang")
    documents.append_snapshots(rows, folder)
    documents.append_snapshots(rows.withColumn("revision", F.when(F.col("lang") == "fr", "again").otherwise(F.col("revision"))), folder)
    return committed(spark, folder).drop("snapshot_date")


@check("training_pairs", """WITH m AS (SELECT doc_id, lang AS text, CASE WHEN n_chars > 2000 THEN 'benefit' ELSE 'remove' END AS label FROM documents WHERE source <> 'web'),
h AS (SELECT doc_id, CASE WHEN quality = 1 THEN lang ELSE 'fixed' END AS text, CASE WHEN toxic = 1 THEN 'remove' WHEN n_chars > 2000 THEN 'benefit' ELSE 'other' END AS label, n_chars < 9000 AS selected
  FROM labels JOIN documents USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS video_id, doc_id AS id, m.label AS model_label, h.label AS human_label, CASE WHEN h.text IS NULL THEN 'deleted' WHEN m.text IS NULL THEN 'added'
  WHEN m.text = h.text AND m.label = h.label THEN 'kept' ELSE 'corrected' END AS change,
  CASE WHEN h.text IS NULL THEN NULL WHEN NOT selected OR h.label = 'remove' THEN 'negative' ELSE 'positive' END AS verdict FROM m FULL JOIN h USING (doc_id)""")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.col("doc_id").alias("id"), "doc_id", "lang", "n_chars", "source")
    model = docs.filter("source <> 'web'").select("video_id", "id", F.col("lang").alias("text"), F.when(F.col("n_chars") > 2000, "benefit").otherwise("remove").alias("label"))
    human = docs.join(b.table(spark, sf, "labels"), "doc_id").select(
        "video_id", "id", F.when(F.col("quality") == 1, F.col("lang")).otherwise("fixed").alias("text"),
        F.when(F.col("toxic") == 1, "remove").when(F.col("n_chars") > 2000, "benefit").otherwise("other").alias("label"), (F.col("n_chars") < 9000).alias("selected"))
    return projects.training_pairs(model, human).select("video_id", "id", "model_label", "human_label", "change", "verdict")


STAMP = "CAST({0} // 360000 AS VARCHAR) || ':' || lpad(CAST({0} // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"
SCRIPT = b.with_sql("captions") + r""", look AS (SELECT CAST(c_custkey AS VARCHAR) AS video_id, '{\an2\pos(' || CAST(round_even(1080 * least(100.0, c_nationkey * 4.5) / 100, 0) AS BIGINT) || ',1740)}' AS pos FROM customer),
timed AS (SELECT *, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) AS s, CAST(round_even(end_ms / 10.0, 0) AS BIGINT) AS e FROM captions JOIN look USING (video_id) WHERE trim(text) <> '')
SELECT video_id, id, 'Dialogue: 0,' || """ + STAMP.format("s") + " || ',' || " + STAMP.format("e") + r""" || ',Default,,0,0,0,,' || pos ||
  replace(replace(replace(replace(replace(text, '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\N'), 'tion', '{\c&H003BD4FF}tion{\c&H00FFFFFF}') AS line FROM timed"""


@check("caption_events", SCRIPT)
def _(spark, sf):
    rows = b.captions(spark, sf).withColumn("highlight_words", F.array(F.lit("tion")))
    settings = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), (F.col("c_nationkey") * 4.5).alias("subtitle_x"))
    return projects.caption_events(rows, settings).filter("section = 1").select("video_id", "id", "line")


@check("event_scripts", SCRIPT)
def _(spark, sf):
    """The same lines, written as sorted files and read back."""
    rows = b.captions(spark, sf).withColumn("highlight_words", F.array(F.lit("tion")))
    settings = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), (F.col("c_nationkey") * 4.5).alias("subtitle_x"))
    folder = new_folder(spark, "scripts")
    projects.write_event_scripts(projects.caption_events(rows, settings), folder)
    return spark.read.parquet(folder).filter("section = 1").select("video_id", "id", "line")


HEADER = ["[Script Info]", "ScriptType: v4.00+", "PlayResX: 1080", "PlayResY: 1920", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]",
          "Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding",
          "STYLE", "", "[Events]", "Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"]
STYLE = """'Style: Default,华文琥珀,' || (20 + c_nationkey) || ',&H00FFFFFF,&H00FFFFFF,&H00101010,&H44000000,-1,0,0,0,100,100,0,0,1,4,1,2,50,50,' || (c_nationkey * 7) || ',1'"""


@check("caption_script_header", "SELECT CAST(c_custkey AS VARCHAR) AS video_id, unnest(range(0, 13)) AS id, unnest([" + ", ".join(STYLE if x == "STYLE" else f"'{x}'" for x in HEADER) + "]) AS line FROM customer")
def _(spark, sf):
    """All lines of the header, size and margin read off the customer."""
    nation = F.col("c_nationkey")
    settings = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), (nation + 20).alias("font_size"), (nation * 7).alias("margin_v"))
    return projects.caption_events(b.captions(spark, sf), settings).filter("section = 0").select("video_id", "id", "line")


# ---- assets: parts as files, named folders of brand, type and name

KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
SCORES = f"""WITH p AS (SELECT DISTINCT p_name AS product, {KEY.format('p_name')} AS pk FROM part), f AS (SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_name AS folder FROM part),
pairs AS (SELECT product, folder, list_distinct(string_split(pk, '')) AS q, list_distinct(string_split({KEY.format('folder')}, '')) AS n, pk, {KEY.format('folder')} AS fk FROM p, f),
scored AS (SELECT product, folder, len(list_intersect(q, n)) / len(q) + CASE WHEN contains(fk, pk) OR contains(pk, fk) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM pairs),
scores AS (SELECT * FROM scored WHERE score >= 0.32)"""


def _library(spark, sf):
    part = b.table(spark, sf, "part").withColumn("folder", F.concat_ws(" ", "p_brand", "p_type", "p_name"))
    return part.select(F.col("p_name").alias("product")).distinct(), part.select("folder").distinct(), part.select(
        "folder", F.col("p_partkey").cast("string").alias("name"), F.concat(F.col("folder"), F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"))


@check("folder_scores", SCORES + " SELECT product, folder, round(score, 6) AS score FROM scores")
def _(spark, sf):
    made, folders, _ = _library(spark, sf)
    return assets.folder_scores(made, folders).withColumn("score", F.round("score", 6))


@check("match_assets", SCORES + """, best AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, folder) AS folder_rank FROM scores),
files AS (SELECT p_brand || ' ' || p_type || ' ' || p_name AS folder, CAST(p_partkey AS VARCHAR) AS name, p_brand || ' ' || p_type || ' ' || p_name || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path FROM part),
ranked AS (SELECT product, folder, folder_rank, name, row_number() OVER (PARTITION BY product ORDER BY folder_rank, path) AS file_rank FROM best JOIN files USING (folder) WHERE folder_rank <= 5)
SELECT product, folder, folder_rank, file_rank, name FROM ranked WHERE file_rank <= 40""")
def _(spark, sf):
    out = assets.match_assets(*_library(spark, sf))
    return out.select("product", "folder", F.col("folder_rank").cast("bigint").alias("folder_rank"), F.col("file_rank").cast("bigint").alias("file_rank"), "name")


# ---- sources

@check("recent_media", """SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '\\.([^.]+)$', 1)) = 'html' ORDER BY page_id // 7 DESC, url LIMIT 30""")
def _(spark, sf):
    files = b.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.col("url").alias("name"), F.floor(F.col("page_id") / 7).alias("modificationTime"))
    return media.recent_media(files, 30, "html").select("page_id", F.col("path").alias("url"))


@check("flatten_probe", """SELECT o_orderkey, CAST(o_custkey * 1000 + 500 AS BIGINT) AS duration_ms, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1080 END AS width, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 30000 END AS fps_num,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'h264' END AS video_codec, 'aac' AS audio_codec FROM orders""")
def _(spark, sf):
    def stream(kind, codec, width, rate):
        return F.struct(F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"), F.lit(width).cast("int").alias("width"), F.lit(rate).cast("string").alias("r_frame_rate"))

    sound, picture = stream("audio", "aac", None, "0/0"), stream("video", "h264", 1080, "30000/1001")
    streams_ = F.when(F.col("o_orderstatus") == "P", F.array(sound)).otherwise(F.array(sound, picture, stream("video", "mjpeg", 5, "1/1")))
    doc = F.to_json(F.struct(F.struct(F.concat("o_custkey", F.lit(".5000")).alias("duration")).alias("format"), streams_.alias("streams")))
    rows = media.flatten_probe(b.table(spark, sf, "orders").select("o_orderkey", doc.alias("probe")))
    return rows.select("o_orderkey", "duration_ms", "width", "fps_num", "video_codec", "audio_codec")


@check("with_cached_stage", "SELECT doc_id, length(text) AS size, lang || ':' || CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS made FROM documents")
def _(spark, sf):
    """English documents are worked on first; the second run only adds the others."""
    docs, cache = b.table(spark, sf, "documents"), new_folder(spark, "stage")
    stage = lambda name: lambda df: df.select("stage_key", "doc_id", F.length("text").alias("size"), F.concat("lang", F.lit(f":{name}")).alias("made"))
    media.with_cached_stage(docs.filter("lang = 'en'"), cache, ["doc_id", "lang"], stage("first"))
    return media.with_cached_stage(docs, cache, ["doc_id", "lang"], stage("second")).drop("stage_key")


@check("cache_hits", "SELECT lang, count(*) AS inputs, count(*) FILTER (lang = 'en') AS hits FROM documents GROUP BY lang")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "lang")
    known = docs.filter("lang = 'en'").select(media.fingerprint(["doc_id", "lang"]).alias("stage_key"))
    return media.cache_hits(docs, known, ["doc_id", "lang"]).groupBy("lang").agg(F.count(F.lit(1)).alias("inputs"), F.count_if("hit").alias("hits"))


# ---- listings, over the events written as one folder for each kind

def _written_library(spark, sf):
    folder = new_folder(spark, "library")
    b.table(spark, sf, "events").select("event_type", "event_id").repartition(12, "event_type", F.col("event_id") % 3).write.partitionBy("event_type").parquet(folder)
    return folder


def _held(spark, folder, files):
    """What lies in the listed files: a file left out, or listed twice, shows in the sums."""
    rows = spark.read.option("basePath", folder).parquet(folder).withColumn("_path", F.input_file_name())
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "%3D", "=")
    found = rows.withColumn("_path", plain("_path")).join(files.select(plain("path").alias("_path")), "_path")
    return found.groupBy(F.concat(F.lit("event_type="), "event_type").alias("folder")).agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


HELD = "SELECT 'event_type=' || event_type AS folder, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type"


@check("media_files", HELD)
def _(spark, sf):
    folder = _written_library(spark, sf)
    return _held(spark, folder, media.media_files(spark, folder, recursive=True, extensions=("parquet",)))


@check("asset_files", f"SELECT * FROM ({HELD}) WHERE folder <> 'event_type=view'")
def _(spark, sf):
    folder = _written_library(spark, sf)
    return _held(spark, folder, media.asset_files(spark, folder, extensions=("parquet",), excluded=("event_type=view",)))


@check("stream_new_media", HELD)
def _(spark, sf):
    folder = _written_library(spark, sf)
    files = streams.stream_new_media(spark, folder, max_files=2, extensions=("parquet",))
    rows = _drained(spark, files.select("path", "item_id"), "media-stream")
    return _held(spark, folder, rows.filter(F.length("item_id") > 10))


@check("keep_items", HELD)
def _(spark, sf):
    """The stream of new media run twice from its start: the item table has each file once."""
    folder, table = _written_library(spark, sf), new_folder(spark, "items")
    for run in range(2):
        streams.keep_items(streams.stream_new_media(spark, folder, max_files=4, extensions=("parquet",)), table, new_folder(spark, f"kept-{run}")).awaitTermination()
    listed = media.media_files(spark, folder, recursive=True, extensions=("parquet",)).select("path", video_key(F.col("path")).alias("item_id"))
    return _held(spark, folder, committed(spark, table).join(listed, "item_id"))


# ---- streams: the events table read as a stream, run to its end

def _stream(spark, sf):
    ddl = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(ddl).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drained(spark, rows, name):
    folder = new_folder(spark, name)
    query = (rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@check("stream_gap_captions", """WITH marked AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS g FROM marked), sessions AS (SELECT user_id, g, min(us) AS f, max(us) AS l, count(*) AS n FROM grouped GROUP BY user_id, g)
SELECT CAST(user_id AS VARCHAR) AS video_id, f AS first_us, l AS last_us, n AS n_tokens FROM sessions WHERE l + 21600000000 <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 60000) * 1000""")
def _(spark, sf):
    """Groups the watermark has passed by the end of the table; the rest are still open."""
    tokens = _stream(spark, sf).select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = _drained(spark, streams.stream_gap_captions(tokens, "6 hours", "60 seconds"), "gap-stream")
    us = lambda c: b.millis(F.col(c).cast("timestamp_ntz")) * 1000 + F.unix_micros(c) % 1000 + 1_704_067_200_000_000
    return rows.select("video_id", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "n_tokens")


PASSED = """, passed AS (SELECT CAST(user_id AS VARCHAR) AS item_id, count(*) AS n FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) GROUP BY user_id)"""


@check("stream_review_state", LOG + PASSED + """ SELECT item_id, p AS processing, ready, rev AS revision, reviewed AS reviewed_revision, exported AS exported_revision, e AS export_status
FROM fold JOIN passed USING (item_id, n) WHERE alive""")
def _(spark, sf):
    """What the watermark has passed by the end of the table."""
    from cuetable.checks.review import event_log
    batch = event_log(spark, sf)  # the same columns, built over the stream
    v = F.col("value")
    source = _stream(spark, sf).select(*log_columns(v, _action(v)))
    rows = _drained(spark, streams.stream_review_state(source.select(*batch.columns), "1 hour"), "review-stream")
    return review.review_state(rows).select("item_id", "processing", "ready", "revision", "reviewed_revision", "exported_revision", "export_status")


def _action(v):
    kind = F.col("event_type")
    return (F.when(kind == "view", F.when(v > 60, "claim").otherwise("analysis")).when(kind == "click", F.when(v > 90, "remove").otherwise("save"))
            .when(kind == "purchase", F.when(v > 110, "unapprove").otherwise("approve")).when(kind == "signup", "export")
            .otherwise(F.when(v > 40, "export_status").otherwise("processing")))


@check("stream_block_activity", """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 100) AS BIGINT) AS e FROM events WHERE floor(value * 100) > 0),
o AS (SELECT *, unnest(generate_series(s // 1000, (e - 1) // 1000)) AS block FROM m)
SELECT video_id, block, count(*) AS active, CAST(sum(least(e, (block + 1) * 1000) - greatest(s, block * 1000)) AS BIGINT) AS gain_ms FROM o
WHERE (block + 1) * 1000 <= (SELECT max(block) FROM o) * 1000 - 1000 GROUP BY ALL""")
def _(spark, sf):
    markers = _stream(spark, sf).select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"),
                                        F.floor(F.col("value") * 100).alias("length_ms"), F.lit(1).cast("bigint").alias("gain"))
    rows = _drained(spark, streams.stream_block_activity(markers, "1 second"), "block-stream")
    block = F.floor((b.millis(F.col("block_ts").cast("timestamp_ntz")) + 1_704_067_200_000) / 1000)
    return rows.select("video_id", block.alias("block"), "active", "gain_ms")
