"""Registered queries of URL filters, the Merkle manifest and spelling
variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.llm import manifest, spelling, urls
from mercato.llm.queries import register
from mercato.llm.text import ASCII_UPPER, whole
from mercato.sources.tables import table


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a SQL text, a half byte at a
    time; the table of sixteen follows from the reflected polynomial."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return f"""xor(list_reduce(list_transform(range(0, 2 * octet_length(encode({text}))),
        lambda i: (instr('0123456789ABCDEF', substr(hex(encode({text})),
                   (CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::INT, 1)) - 1)::BIGINT),
        lambda c, b: xor(c >> 4, ({steps})[(xor(c, b) & 15) + 1]), 4294967295::BIGINT),
        4294967295::BIGINT)"""


@register("op13_spelling", f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(list_transform(
               regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'),
               lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
hashed AS (
    SELECT run, {_crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
    FROM runs WHERE length(run) >= 7),
w AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT)
                || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM hashed),
v AS (
    SELECT word, count(*) AS n, length(word) AS size FROM w WHERE length(word) >= 7
    GROUP BY word HAVING count(*) >= 2),
cut AS (
    SELECT word, n, size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT *, unnest(range(1, size + 1))::INT AS i FROM v)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n
    FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(minus := -other_n, other := other)) AS best
    FROM near GROUP BY word),
formed AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN -best.minus >= 10 * v.n THEN best.other END AS form,
           CASE WHEN -best.minus >= 10 * v.n THEN -best.minus END AS form_n
    FROM v LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS root, 0 AS steps FROM v
    UNION ALL
    SELECT chain.word, f.form, steps + 1 FROM chain JOIN formed f ON f.word = chain.root
    WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM formed JOIN last USING (word)
""")
def op13_spelling(spark, sf_dir):
    """Spelling variants among the words of all documents, some of which lose
    a letter first.  Only runs of seven letters or more can become words; a
    row without an id hashes an empty id."""
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(whole("text"), F.lit("[A-Za-zÀ-ÿ]{7,}"),
                                       F.lit(0))).alias("run"))
    runs = docs.select("id", spelling.lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring("run", F.lit(1), at),
                                        F.substring("run", at + 2, F.length("run")))
                  ).otherwise(F.col("run"))
    return spelling.variants(spelling.counted(runs, word, shortest=7, least=2))


def _tree_sql(rows: str, name: str, levels: int) -> str:
    """CTEs that reduce ``rows`` (g, slot, h) to one node a group: runs of
    each level in ``{name}_run{k}``, the end in ``{name}_top``."""
    sql = [f"{name}0 AS (SELECT g, slot, h, count(*) OVER (PARTITION BY g) AS size FROM {rows})"]
    for k in range(levels):
        sql.append(f"""{name}_run{k} AS (
            SELECT g, slot // 8 AS run, max(size) AS size, list(h ORDER BY slot) AS hs
            FROM {name}{k} GROUP BY ALL)""")
        sql.append(f"""{name}{k + 1} AS (
            SELECT g, run AS slot, (size + 7) // 8 AS size,
                   CASE WHEN size = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h
            FROM {name}_run{k})""")
    return ",\n".join(sql + [f"{name}_top AS (SELECT g, h FROM {name}{levels})"])


def _walk_sql(rows: str, name: str, levels: int) -> str:
    """CTEs that walk ``rows`` (g, place, node, proof, ...) up the tree
    ``name``: ``{name}_end`` holds the folded node and all siblings."""
    before = "array_to_string(hs[1:(place % 8)], '')"
    after = "array_to_string(hs[(place % 8 + 2):], '')"
    steps = [f"""{name}_walk{k + 1} AS (
        SELECT w.* REPLACE (
            CASE WHEN size = 1 THEN node ELSE sha256({before} || node || {after}) END AS node,
            CASE WHEN size = 1 THEN proof ELSE proof || {before} || {after} END AS proof,
            place // 8 AS place)
        FROM {f"{name}_walk{k}" if k else rows} w
        JOIN {name}_run{k} r ON w.g = r.g AND w.place // 8 = r.run)""" for k in range(levels)]
    return ",\n".join(steps + [f"{name}_end AS (SELECT * FROM {name}_walk{levels})"])


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(
        f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# eight levels: 16,777,216 rows of a language; the languages, 512
@register("op12_manifest", f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS h,
           CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_LOWERED)} END AS probe
    FROM documents),
rows AS (
    SELECT doc_id, g, h, probe,
           row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS slot
    FROM leaves),
{_tree_sql("rows", "t", 8)},
langs AS (SELECT '' AS g, g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS slot FROM t_top),
{_tree_sql("langs", "r", 3)},
low AS (SELECT doc_id, g, h AS leaf, coalesce(probe, h) AS node, '' AS proof, slot AS place
        FROM rows),
{_walk_sql("low", "t", 8)},
high AS (SELECT e.* REPLACE ('' AS g, l.slot AS place), l.h AS subroot
         FROM t_end e JOIN langs l ON l.lang = e.g),
{_walk_sql("high", "r", 3)}
SELECT doc_id, leaf, subroot, r_top.h AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = r_top.h AS verified
FROM r_end, r_top
""")
def op12_manifest(spark, sf_dir):
    """Manifest of the documents by language; a third of them are verified
    with their letters lowered.  A row without an id is never tampered with."""
    docs = table(spark, sf_dir, "documents")

    def digest(text):
        return manifest.leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
                                  + [text])

    lowered = F.translate("text", ASCII_UPPER, ASCII_UPPER.lower())
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("lang", "doc_id", digest(F.col("text")).alias("leaf"),
                         F.when(tampered, digest(lowered)).alias("probe"))
    return manifest.manifest(leaves, "lang", "doc_id", "leaf", "probe").select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        "verified")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _level_sql(k: int) -> str:
    """Probabilities of the last character after ``k`` characters."""
    def blended(n, total, kinds, p):
        return (f"CASE WHEN {total} > 0 THEN ({n} + {kinds} * {p}) / ({total} + {kinds})::DOUBLE "
                f"ELSE {p} END")
    below = f"JOIN p{k - 1} b ON b.gram = right(s.gram, {k})" if k else "CROSS JOIN even b"
    return f"""
s{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1),
c{k} AS (SELECT left(gram, {k}) AS context, sum(a) AS na, sum(r) AS nr,
               count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM s{k} GROUP BY 1),
p{k} AS (SELECT s.gram, {blended("s.a", "na", "ta", "b.pa")} AS pa,
               {blended("s.r", "nr", "tr", "b.pr")} AS pr
        FROM s{k} s JOIN c{k} c ON c.context = left(s.gram, {k}) {below})"""


@register("op11_url_filter", f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
split AS (
    SELECT page_id, coalesce(url, '') AS url,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END
           AS rest FROM pages),
parts AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
places AS (SELECT DISTINCT host, path FROM parts),
ruled AS (
    SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS said
    FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY host, path),
u AS (
    SELECT url, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r,
           substr(md5(url), 1, 2) < '33' AS held_out
    FROM parts LEFT JOIN ruled USING (host, path) GROUP BY url),
cut AS (
    SELECT *, substr(repeat(chr(2), 4) || url || chr(3), place, 5) AS gram
    FROM (SELECT *, unnest(range(1, length(url) + 2))::INT AS place FROM u)),
g AS (SELECT gram, sum(CASE WHEN held_out THEN 0 ELSE a END) AS a,
             sum(CASE WHEN held_out THEN 0 ELSE r END) AS r FROM cut GROUP BY gram),
even AS (SELECT 1 / 256::DOUBLE AS pa, 1 / 256::DOUBLE AS pr),
{",".join(_level_sql(k) for k in range(urls.ORDER + 1))},
scored AS (
    SELECT url, held_out, a, r,
           floor(sum(round((ln(pa) - ln(pr)) * 1000000)::BIGINT)::DOUBLE / (length(url) + 1)) AS score
    FROM cut JOIN p4 USING (gram) GROUP BY url, held_out, a, r),
steps AS (
    SELECT floor(score / 1000) AS step, sum(a) AS a, sum(r) AS r
    FROM scored WHERE held_out AND a + r > 0 GROUP BY 1),
gains AS (
    SELECT step, (step + coalesce(lag(step) OVER (ORDER BY step) + 1, step)) * 500 AS middle,
           sum(a) OVER up * sum(r) OVER () - sum(r) OVER up * sum(a) OVER () AS gain,
           least(sum(a) OVER (), sum(r) OVER ()) > 0 AS both_kinds
    FROM steps WINDOW up AS (ORDER BY step DESC)),
bar AS (SELECT coalesce(arg_min(middle, (-gain, step)), 0) AS bar
        FROM gains WHERE both_kinds)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN score >= bar THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN ruled USING (host, path) JOIN scored USING (url), bar
""")
def op11_url_filter(spark, sf_dir):
    """Verdict on the URL of every page, by rules or by the models that the
    rules' own verdicts teach."""
    return urls.filtered(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select(
        "page_id", "host", "path", "rule", "verdict")
