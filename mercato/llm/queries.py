"""Registered queries of the text operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (bpe, chat, decontaminate, extraction, fingerprint, licences, neardup,
                         quality, sharding, toxicity)
from mercato.llm.text import held_out, whole
from mercato.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def rank_codec(spark: SparkSession) -> bpe.BytePairCodec:
    import public_tokenizers

    return bpe.BytePairCodec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


@register("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    coded = bpe.encoded(docs, rank_codec(spark))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


@register("op10_fingerprints")
def op10_fingerprints(spark, sf_dir):
    """Fingerprints of every document, of an edited copy, and their likeness
    to each other and to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    paired = fingerprint.with_next(
        docs, "doc_id", {"text": "next_text", "fingerprint": "next_fingerprint"}, "text",
        derive={"fingerprint": fingerprint.fingerprint("text")})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut),
                      F.col("next_text").substr(F.lit(1), cut))
    done = (paired.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
            .withColumn("edited_fingerprint", fingerprint.fingerprint("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        fingerprint.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        fingerprint.likeness("fingerprint", "next_fingerprint").alias("near_next"))


@register("op9_near_duplicates", """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
s AS (
    SELECT doc_id, unnest(list_distinct(CASE
        WHEN len(words) >= 2 THEN list_transform(range(1, len(words)),
                                                 lambda i: words[i] || ' ' || words[i + 1])
        WHEN len(words) = 1 THEN words ELSE [] END)) AS shingle
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
keyed AS (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS k
          FROM s GROUP BY doc_id),
class AS (SELECT k, min(doc_id) AS rep FROM keyed GROUP BY k),
r AS (SELECT s.* FROM s JOIN class ON s.doc_id = class.rep),
both_have AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM r x JOIN r y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id),
e AS (
    SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * c >= 80 * (na.n + nb.n - c)),
und AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
    SELECT rep AS node, rep AS seen FROM class
    UNION
    SELECT reach.node, und.b FROM reach JOIN und ON reach.seen = und.a),
root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       coalesce(root.root, d.doc_id) AS component_id,
       coalesce(root.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN keyed USING (doc_id)
LEFT JOIN class ON class.k = keyed.k LEFT JOIN root ON root.node = class.rep
""")
def op9_near_duplicates(spark, sf_dir):
    """Near duplicates of two-word shingles among all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


# every item has five words or more here; a shorter one would be one shingle
@register("op1_decontamination", """
WITH d AS (
    SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
           '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents),
i AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
           '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM benchmark),
ds AS (
    SELECT doc_id, len(words) AS n, words,
           unnest(range(1, len(words) - 3)) AS pos FROM d),
dsh AS (SELECT doc_id, n, pos, array_to_string(words[pos:pos + 4], ' ') AS g FROM ds),
ish AS (
    SELECT item_id, w, min(pos) AS pos, g FROM (
        SELECT item_id, len(words) AS w, pos, array_to_string(words[pos:pos + 4], ' ') AS g
        FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS pos FROM i))
    GROUP BY item_id, w, g),
place AS (
    SELECT DISTINCT doc_id, item_id, w,
           greatest(0, least(dsh.pos - ish.pos, n - w)) AS start
    FROM dsh JOIN ish USING (g)),
win AS (
    SELECT p.doc_id, p.item_id, p.start, p.w, q.g, count(*) AS c
    FROM place p JOIN dsh q ON q.doc_id = p.doc_id AND q.pos > p.start
         AND q.pos <= p.start + p.w - 4
    GROUP BY ALL),
bag AS (
    SELECT item_id, g, count(*) AS c FROM (
        SELECT item_id, array_to_string(words[pos:pos + 4], ' ') AS g
        FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS pos FROM i))
    GROUP BY ALL),
lesser AS (
    SELECT win.doc_id, win.item_id, win.start, win.w, sum(least(win.c, bag.c)) AS c
    FROM win JOIN bag USING (item_id, g) GROUP BY ALL),
total AS (SELECT doc_id, item_id, start, sum(c) AS c FROM win GROUP BY ALL),
size AS (SELECT item_id, sum(c) AS c FROM bag GROUP BY ALL),
scored AS (
    SELECT l.doc_id, l.item_id, l.start, l.w, l.c AS lesser, t.c + s.c - l.c AS greater
    FROM lesser l JOIN total t USING (doc_id, item_id, start) JOIN size s USING (item_id))
SELECT doc_id, item_id, max(lesser / greater) AS similarity,
       arg_max(start, (lesser / greater, -start))::BIGINT AS word_start,
       max(w)::BIGINT AS item_words
FROM scored WHERE 100 * lesser >= 80 * greater
GROUP BY doc_id, item_id
""")
def op1_decontamination(spark, sf_dir):
    """The benchmark items that each document holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                      table(spark, sf_dir, "benchmark"))


@register("op4_sharding")
def op4_sharding(spark, sf_dir):
    """All documents into eight shards of even counts, equal texts together
    as far as counts allow."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = whole("text").cast("binary")
    docs = raw.select("doc_id", (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
                      F.crc32(data).alias("text_crc32"), F.md5(F.col("text").cast("binary")).alias("same"),
                      F.xxhash64("doc_id", F.lit("place")).alias("spread"))
    out = sharding.balanced_shards(docs, "same", "spread")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _graded(scored, threshold: float):
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _graded(toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels")),
                   toxicity.TOXIC_FROM)


@register("op8_quality")
def op8_quality(spark, sf_dir):
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _graded(quality.quality_scores(docs, table(spark, sf_dir, "labels")),
                   quality.KEEP_FROM)


@register("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extracted(pages).select("page_id", "url", "text",
                                              F.length("text").cast("long").alias("n_chars"))


_LICENCE_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''"))
                          for i, (name, text) in enumerate(licences.TEMPLATES))


def document_paths(docs):
    """Documents as files: source/lang/shelf/doc_id, those of round ids on
    source/lang itself."""
    shelf = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/")))
    return docs.withColumn("path", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                                            shelf, F.col("doc_id").cast("string")))


@register("op3_licences", f"""
WITH t AS (SELECT * FROM (VALUES {_LICENCE_ROWS}) v(template, licence, body)),
tw AS (SELECT DISTINCT template, licence, unnest(list_filter(regexp_split_to_array(lower(body),
              '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM t),
idf AS (SELECT word, pow(ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1, 2) AS weight
        FROM tw GROUP BY word),
post AS (SELECT template, licence, word, weight, sum(weight) OVER (PARTITION BY template) AS norm
         FROM tw JOIN idf USING (word)),
f AS (SELECT doc_id, text, source || '/' || lang || '/' || CASE WHEN doc_id % 10 = 0 THEN ''
             ELSE (doc_id // 1000)::VARCHAR || '/' END || doc_id::VARCHAR AS path FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS body
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM f)),
paragraphs AS (SELECT doc_id, -generate_subscripts(l, 1) AS line, unnest(l) AS body
               FROM (SELECT doc_id, list_transform(regexp_split_to_array(
                     coalesce(text, ''), '\n[ \t\r]*\n'), lambda x: trim(x)) AS l FROM f)),
units AS (SELECT doc_id, line, body FROM lines
          UNION ALL SELECT doc_id, line, body FROM paragraphs WHERE contains(body, chr(10))
          UNION ALL SELECT doc_id, 0, coalesce(text, '') FROM f),
w AS (SELECT DISTINCT doc_id, line, unnest(list_filter(regexp_split_to_array(lower(body),
             '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM units),
size AS (SELECT doc_id, line, sum(coalesce(weight, pow(ln(1.0 + (SELECT count(*) FROM t)) + 1, 2))) AS size
         FROM w LEFT JOIN idf USING (word) GROUP BY doc_id, line),
cos AS (SELECT doc_id, line, template, licence,
               round(sum(weight) / sqrt(any_value(size) * any_value(norm)), 6) AS cosine
        FROM w JOIN post USING (word) JOIN size USING (doc_id, line)
        GROUP BY doc_id, line, template, licence),
best AS (SELECT doc_id, line, licence, cosine FROM cos WHERE cosine >= 0.6
         QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY cosine DESC, licence) = 1),
stated AS (SELECT doc_id, licence, cosine FROM best WHERE line <> 0
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
offer AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, path AS from_path, b.licence, b.cosine
          FROM best b JOIN f USING (doc_id) JOIN stated USING (doc_id) WHERE line = 0
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY b.cosine DESC, path, b.licence) = 1),
given AS (SELECT f.doc_id, o.licence, o.cosine, o.from_path
          FROM f JOIN offer o ON o.dir = regexp_replace(f.path, '/?[^/]*$', '')
               OR starts_with(regexp_replace(f.path, '/?[^/]*$', ''), o.dir || '/')
          QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(o.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(s.licence, g.licence) AS licence,
       coalesce(s.cosine, g.cosine) AS cosine,
       CASE WHEN s.licence IS NOT NULL THEN 'statement'
            WHEN g.licence IS NOT NULL THEN 'inherited' END AS found,
       CASE WHEN s.licence IS NOT NULL THEN f.path ELSE g.from_path END AS from_path
FROM f LEFT JOIN stated s USING (doc_id) LEFT JOIN given g USING (doc_id)
""")
def op3_licences(spark, sf_dir):
    """The licence of every document, its own or that of its directory."""
    docs = document_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return licences.scanned(docs.select("doc_id", "path", "text")).drop("text")


# a turn of the user is a call for a reply, the assistant's next turn its result
REPLY_SCHEMA = {"reply": {"prompt": ("STRING", True), "turn": ("BIGINT", True)}}


@register("op7_chat", """
WITH RECURSIVE m AS (
    SELECT DISTINCT conv_id, turn, role, text,
           CASE WHEN role = 'user' THEN conv_id || ':' || turn END AS call_id,
           CASE WHEN role = 'user' THEN conv_id || ':' || (turn - 2) END AS after,
           CASE WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS result_for
    FROM conversations),
j AS (
    SELECT *, CASE
        WHEN call_id IS NOT NULL THEN to_json({role: role, tool_calls: [{arguments:
             {prompt: text, turn: turn}, id: call_id, name: 'reply'}]})::VARCHAR
        WHEN result_for IS NOT NULL THEN
             to_json({content: text, role: role, tool_call_id: result_for})::VARCHAR
        ELSE to_json({content: text, role: role})::VARCHAR END AS json
    FROM m),
n AS (
    SELECT j.*, c.call_id IS NOT NULL AS asked, r.result_for IS NOT NULL AS answered,
           b.call_id AS before, br.result_for AS before_result
    FROM j LEFT JOIN j c ON c.call_id = j.result_for LEFT JOIN j r ON r.result_for = j.call_id
    LEFT JOIN j b ON b.call_id = j.after LEFT JOIN j br ON br.result_for = b.call_id),
parent AS (
    SELECT *, CASE WHEN asked THEN 'c' || result_for
                   WHEN before_result IS NOT NULL THEN 'r' || before_result
                   WHEN before IS NOT NULL THEN 'c' || before END AS up,
           coalesce('c' || call_id, 'r' || result_for, 'p' || conv_id || ':' || turn) AS me
    FROM n),
lv AS (
    SELECT me, 0 AS level FROM parent WHERE up IS NULL
    UNION ALL SELECT p.me, lv.level + 1 FROM parent p JOIN lv ON p.up = lv.me)
SELECT conv_id, turn, role, level::INTEGER AS level,
       CASE WHEN result_for IS NOT NULL THEN CASE WHEN asked THEN 'linked' ELSE 'orphan_result' END
            WHEN call_id IS NOT NULL THEN CASE WHEN answered THEN 'linked' ELSE 'open' END
            ELSE 'plain' END AS status,
       CASE WHEN call_id IS NOT NULL THEN text IS NOT NULL AND turn IS NOT NULL END AS arguments_ok,
       json,
       row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, json) - 1 AS position
FROM parent JOIN lv USING (me)
""")
def op7_chat(spark, sf_dir):
    """Every turn of the conversations as a call, a result or a plain message."""
    t = table(spark, sf_dir, "conversations")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"

    def turn_id(back: int):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"),
                        (F.col("turn") - back).cast("string"))

    # a user's text is the prompt of its call
    content = F.when(~F.coalesce(user, F.lit(False)), F.col("text"))
    return chat.formatted(t.select(
        "conv_id", "turn", "role", content.alias("text"), F.when(user, turn_id(0)).alias("call_id"),
        F.when(user, F.lit("reply")).alias("tool"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("arguments"),
        F.when(user, turn_id(2)).alias("after"),
        F.when(assistant, turn_id(1)).alias("result_for")), REPLY_SCHEMA)
