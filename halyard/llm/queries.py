"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, filter_audit, fingerprints, langid, pii, secret_scan, shards, simhash, spelling, substring_dedup, token_counts
from ._blocks import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings and the escape itself.
PROBE = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.prefix_tree(given.unionByName(probe))).drop("intervals")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"), words=3, radius=2)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.findings(read(spark, sf_dir, "documents")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(read(spark, sf_dir, "documents")))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(substring_dedup.remove_repeats(read(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_bpe, op3_chat_format, op4_simhash, op5_shards, op6_language, op7_decontaminate, op8_secrets,
        op9_fingerprints, op10_pii, op11_substring_dedup, op12_spelling, op13_filter_audit,
    )
}

# what SQL can say -----------------------------------------------------------------------------

_ESCAPES = " + ".join(
    f"(length({{0}}) - length(replace({{0}}, {s}, ''))) // {n}" for s, n in (("chr(92)", 1), ("'<turn>'", 6), ("'</turn>'", 7))
)

CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(15 + length(role) + length(text) + {_ESCAPES.format("text")} + {_ESCAPES.format("role")} + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAK_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS ws FROM benchmark),
 w AS (SELECT DISTINCT item, least(10, len(ws)) AS n, ws[p:p + least(10, len(ws)) - 1] AS win
       FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0) x),
 p AS (SELECT doc_id, n, p, ws[p:p + n - 1] AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM w) s WHERE len(ws) >= n) x),
 h AS (SELECT p.doc_id, p.n, p.p, w.item FROM p JOIN w ON p.win = w.win AND p.n = w.n),
 hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM h) x GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


#: The rules' patterns with letters of either case spelt out.
_SECRETS = [
    (
        "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
        + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    ),
    *(pattern for _, pattern, _, _ in secret_scan.RULES[1:]),
]


def _secret_sql() -> str:
    parts = [
        f"""SELECT doc_id, {k} AS kind, '{name}' AS name, i, length(g[i]) AS gap, length(m[i]) AS size, length(c[i]) >= {least} AS ok
 FROM (SELECT doc_id, m, c, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{own}', 0) AS m, regexp_extract_all(t, '{own}', {group}) AS c,
       string_split_regex(t, '{own}') AS g FROM d) a) b"""
        for k, ((name, _, group, least), own) in enumerate(zip(secret_scan.RULES, _SECRETS))
    ]
    listed = "string_agg(name || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 f AS ({" UNION ALL ".join(parts)}),
 s AS (SELECT * FROM (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM f) x WHERE ok)
SELECT d.doc_id, count(*) FILTER (s.kind = 0) AS n_assign, count(*) FILTER (s.kind = 1) AS n_access, count(*) FILTER (s.kind = 2) AS n_hex,
       sha256(coalesce({listed} FILTER (s.kind < 3), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


REPEATS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20) x),
 r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS k FROM (SELECT doc_id, p, rank() OVER (PARTITION BY win ORDER BY doc_id, p) AS place FROM w) x WHERE place > 1),
 k AS (SELECT doc_id, list(k) AS gone, count(*) AS n FROM r GROUP BY doc_id),
 u AS (SELECT d.doc_id, string_agg(u.w, ' ' ORDER BY u.p) AS kept
       FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) u JOIN d ON d.doc_id = u.doc_id
       LEFT JOIN r ON r.doc_id = u.doc_id AND r.k = u.p WHERE r.k IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(u.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id"""

# a permutation of the letters by joining them; each document meets each order and step once
AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
 m AS (SELECT w.doc_id, part,
        (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS bad FROM w),
 g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (bad) AS nb FROM m GROUP BY part, fails),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM f a JOIN f b ON b.c <> a.c JOIN f x ON x.c NOT IN (a.c, b.c)
       JOIN f y ON y.c NOT IN (a.c, b.c, x.c) JOIN f z ON z.c NOT IN (a.c, b.c, x.c, y.c)),
 s AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS earlier FROM o, generate_series(1, 5) q(step)),
 r AS (SELECT g.part, s.filter_order, s.step, s.c, g.*, s.earlier, contains(g.fails, s.c) AS hit,
              len(translate(g.fails, s.earlier, '')) < len(g.fails) AS gone FROM g CROSS JOIN s),
 a AS (SELECT part, filter_order, step, c, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
              sum(n) FILTER (fails = c) AS unique_fails, sum(ng) FILTER (hit AND NOT gone) AS good_lost, sum(nb) FILTER (hit AND NOT gone) AS toxic_lost
       FROM r GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM a"""

ORACLES: dict[str, str] = {"op3_chat_format": CHAT_SQL, "op7_decontaminate": LEAK_SQL, "op8_secrets": _secret_sql(), "op11_substring_dedup": REPEATS_SQL, "op13_filter_audit": AUDIT_SQL}
