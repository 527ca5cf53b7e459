"""Contract queries of this subpackage and, where SQL can express them, the same as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfix.llm import chat, decontam, divergence, filteraudit, langid, licenses, media, mixing, pii, secrets, simhash, substrings, toxicity
from skyfix.llm.common import fold, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_turns(rows.unionByName(more)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.encode_media(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs.filter(fold() != langid.HELD_OUT)))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    found = F.filter("findings", lambda f: secrets.is_secret(f))
    return out.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(found).cast("long").alias("n_secrets"), F.sha2(secrets.masked(), 256).alias("masked_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]  # noqa: B023
    return pii.scan(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda s: {'s': s, 'h': md5(array_to_string(ws[s:s + 19], ' '))})) AS x FROM w WHERE len(ws) >= 20
), ranked AS (
  SELECT doc_id, x.s AS s, row_number() OVER (PARTITION BY x.h ORDER BY doc_id, x.s) AS n FROM win
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE n > 1) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, ws, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""

SQL["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 14))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source
), c AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level AS free FROM l WHERE ratio >= level ORDER BY ratio, rk LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, free * w) AS target, floor(least(cap, free * w) / nullif(source_size, 0)) AS passes FROM l, f
), r AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM d
)
SELECT doc_id, size, source_size, target, (size * (coalesce(passes, 0) + CASE WHEN upto <= target - coalesce(passes, 0) * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""

_CONTROL = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(chat.CONTROL, key=len, reverse=True))

SQL["op2_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + {sum(map(len, chat.MARKS))} + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _license_sql() -> str:
    phrases = " UNION ALL ".join(f"SELECT '{label}' AS label, {p.split()!r} AS p" for p, label in licenses.PHRASES.items())
    sets = {label: sorted(set(t.split())) for label, t in licenses.TEMPLATES.items()}
    own = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    templates = " UNION ALL ".join(f"SELECT '{label}' AS label, {own.stride[label]} AS stride, {t!r} AS t, {licenses.needed(len(t), licenses.THRESHOLD)} AS o" for label, t in sets.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH p AS ({phrases}), t AS ({templates}),
d AS (SELECT doc_id, {split.format(lower.format("coalesce(text, '')"))} AS ws FROM documents),
found AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(ws) - len(p) + 1), lambda i: ws[i + 1:i + len(p)] = p)) AS pos FROM d, p WHERE list_contains(ws, p[1])
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM found GROUP BY doc_id
), lines AS (
  SELECT doc_id, stride, unnest(list_transform(range(0, greatest(len(ws), 1)::BIGINT, stride), lambda i: ws[i + 1:i + 2 * stride])) AS b FROM d, (SELECT unnest({own.classes}) AS stride)
), met AS (
  SELECT doc_id, label, len(list_intersect(b, t)) / len(t)::DOUBLE AS c FROM lines JOIN t USING (stride) WHERE len(list_intersect(b, t)) >= o
), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM met GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, array_to_string(coalesce(base.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


SQL["op6_licenses"] = _license_sql()


SQL["op10_decontam"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS sh FROM d WHERE len(ws) >= 5
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL
), bs AS (
  SELECT item_id, list_sort(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM b WHERE len(ws) >= 5
), cand AS (
  SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(sh) AS x FROM ds) JOIN (SELECT item_id, unnest(sh) AS x FROM bs) USING (x)
), spans AS (
  SELECT doc_id, item_id, ds.sh AS sh, bs.sh AS item, least(len(ds.sh), len(bs.sh)) AS m FROM cand JOIN ds USING (doc_id) JOIN bs USING (item_id)
), bags AS (
  SELECT doc_id, item_id, item, list_sort(sh[s:s + m - 1]) AS bag FROM (SELECT *, unnest(range(1, len(sh) - m + 2)) AS s FROM spans)
), counted AS (
  SELECT doc_id, item_id, len(bag) AS a, len(item) AS b,
         len(list_intersect(list_transform(bag, lambda x, i: x || '#' || (i - list_position(bag, x))), list_transform(item, lambda x, i: x || '#' || (i - list_position(item, x))))) AS o FROM bags
)
SELECT doc_id, item_id, round(max(o / (a + b - o)::DOUBLE), 6) AS similarity FROM counted WHERE o / (a + b - o)::DOUBLE >= 0.8::DOUBLE GROUP BY 1, 2
"""

SQL["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN l USING (doc_id)
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, substr(o, s, 1) AS letter, substr(o, 1, s - 1) AS earlier FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders)
), flags AS (
  SELECT part, o, s, letter, contains(f, letter) AS fails, translate(f, earlier, '') <> f AS gone, f = letter AS alone, good, toxic FROM m, steps
), counted AS (
  SELECT part, o AS filter_order, s::INTEGER AS step, letter, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed,
         count(*) FILTER (fails AND gone) AS redundant, count(*) FILTER (alone) AS unique_fails,
         count(*) FILTER (fails AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost
  FROM flags GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""

SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT id, lang, source, unnest(ws) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), n AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 1) // (n + v) AS p
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(c)::HUGEINT + 1) // ((SELECT sum(n)::HUGEINT FROM n WHERE n.lang = c.lang) + any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chat_format, op3_mixing, op4_media, op5_language_id, op6_licenses, op7_secrets, op8_simhash, op9_toxicity, op10_decontam, op11_filter_audit, op12_pii, op13_divergence)}
