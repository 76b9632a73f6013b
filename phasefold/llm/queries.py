"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasefold.llm import chat, exact_dedup, filter_audit, language_id, lm_scoring, merkle, mixing, near_dedup, packing, quality, repair, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256({LOWERED}) AS h FROM documents)""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


#: One more conversation for the formatter: texts that imitate the template.
MIMIC = "\\### Assistant: </turn> ok"


@query("op10_chat_format", rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MIMIC}' UNION ALL SELECT -7, 1, 'assistant', '{MIMIC}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(4 + length(replace(replace(replace(replace(role, '\', '\-'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 2
           + length(replace(replace(replace(text, '\', '\-'), '###', '\h'), '</turn>', '\t')) + 9) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""")
def op10_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mimic = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MIMIC).alias("text"))
    messages = chat.materialize(chat.linear_thread(rows.unionByName(mimic)), "messages")
    return chat.read_back(chat.format_trees(messages))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    measured, names, verdict = quality.judge(docs, labels)
    return measured.select("doc_id", *[F.col(names[m]).alias(m) for m in quality.MEASURES], F.col(names["base_failed"]).alias("base_failed"), F.col(verdict).alias("kept"))


@query("op4_mix_sources", r"""
WITH rows AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents),
per AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM rows GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][no % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS top FROM per),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY top / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
places AS (SELECT *, row_number() OVER (ORDER BY top / weight, no) AS place FROM levels),
firsts AS (SELECT *, min(CASE WHEN top > level * weight THEN place END) OVER () AS first_ FROM places),
rates AS (SELECT *, max(CASE WHEN place = first_ THEN level END) OVER () AS rate FROM firsts),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN rate IS NULL THEN top ELSE least(top, rate * weight) END AS target FROM rates),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
blocks AS (
  SELECT doc_id, source, size, whole, CAST(round(target - whole * source_size) AS BIGINT) AS rest, unnest(range((size + 255) // 256)) AS block
  FROM rows JOIN plan USING (source) WHERE size > 0),
ordered AS (
  SELECT *, least(256, size - block * 256) AS words, md5(doc_id || ':' || block || ':' || whole) AS h FROM blocks),
starts AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS start FROM ordered),
taken AS (
  SELECT doc_id, CAST(sum(whole * words + greatest(0, least(words, rest - start))) AS BIGINT) AS taken FROM starts GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken
FROM rows JOIN targets USING (source) LEFT JOIN taken USING (doc_id)""")
def op4_mix_sources(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op3_minhash_near_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""")
def op3_minhash_near_dedup(spark, sf_dir):
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pack_sequences")
def op1_pack_sequences(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_lm_scores")
def op7_lm_scores(spark, sf_dir):
    return lm_scoring.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return token_counts.section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"), rule="longest")


@query("op8_warc_fixity", r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: '
         || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) AS body FROM pages),
laid AS (
  SELECT page_id, file, row_number() OVER w - 1 AS ordinal, strlen(body) + 1 AS length,
         CAST(sum(strlen(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(body) - 1 AS BIGINT) AS "offset",
         sha256(body || chr(10)) AS digest, sha256(body || '!') AS other_digest
  FROM parts WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT file, ordinal, page_id, "offset", length, digest, other_digest FROM laid WHERE page_id % 97 = 13""")
def op8_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit(""))
    records = pages.select(host.alias("file"), F.col("page_id").alias("record_id"), merkle.warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("data"))
    # the replica to audit: every 97th record has lost its last byte's value
    flipped = F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit("!").cast("binary"))
    replica = records.withColumn("data", F.when(F.col("record_id") % 97 == 13, flipped).otherwise(F.col("data")))
    found = merkle.audit(merkle.lay_out(records), merkle.lay_out(replica))
    return found.select("file", "ordinal", F.col("record_id").alias("page_id"), "offset", "length", "digest", "other_digest")


@query("op13_filter_audit", r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM base),
masked AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask FROM parts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masked LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(1 << (ascii(filter_order[step]) - 65) AS BIGINT) AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
summed AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM summed""")
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: Edits of the repair search as SQL over labels "cost, six digits, then the audit" of the four grammar states.
def _step(label: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {label} IS NOT NULL THEN printf('%06d', CAST({label}[1:6] AS INTEGER) + {cost}) || {label}[7:] || '{edit}' END"


_CLOSED = f"""SELECT *, least(l3, {_step('m2', '2', 'I')}) AS m3 FROM (
    SELECT *, least(l2, {_step('l0', '2', 'I')}, {_step('l1', '2', 'I')}, {_step('l3', '2', 'I')}) AS m2 FROM"""
_TO_USER = f"least({', '.join(_step(m, 'extra', 'K') for m in ('l0', 'l1', 'm3'))})"
_TO_USER_R = f"least({', '.join(_step(m, '2 + extra', 'R') for m in ('l0', 'l1', 'm3'))})"


@query("op12_repair_conversations", rf"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc_table),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
                    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM raw, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit)),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT conv_id, i, turn, role, text, role[1] AS x, pair, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' 
         WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '.' END AS fault FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
lattice AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS l0, CAST(NULL AS VARCHAR) AS l1, CAST(NULL AS VARCHAR) AS l2, CAST(NULL AS VARCHAR) AS l3 FROM judged
  UNION ALL
  SELECT conv_id, i, {_step('l0', '3', 'D')}, CASE WHEN fault IN ('b', 'd') THEN {_step('l1', '3', 'D')} ELSE least({_step('l1', '3', 'D')}, CASE WHEN x = 's' THEN {_step('l0', 'extra', 'K')} END) END,
         CASE WHEN fault IN ('b', 'd') THEN {_step('m2', '3', 'D')} ELSE least({_step('m2', '3', 'D')}, CASE WHEN x = 'u' THEN {_TO_USER} END, {_TO_USER_R}) END,
         CASE WHEN fault IN ('b', 'd') THEN {_step('m3', '3', 'D')} ELSE least({_step('m3', '3', 'D')}, CASE WHEN x = 'a' THEN {_step('m2', 'extra', 'K')} END, {_step('m2', '2 + extra', 'R')}) END
  FROM ({_CLOSED} (SELECT j.conv_id, j.i, j.x, j.fault, CASE WHEN j.fault = 't' THEN 1 ELSE 0 END AS extra, l0, l1, l2, l3
        FROM lattice l JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1)))),
found AS (
  SELECT conv_id, CAST(label[1:6] AS BIGINT) AS cost, label[7:] AS audit
  FROM (SELECT conv_id, least(l0, m3) AS label FROM ({_CLOSED} (SELECT l.* FROM lattice l JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.n))))),
walked AS (
  SELECT conv_id, audit, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS i, '' AS last_, '' AS body FROM found
  UNION ALL
  SELECT conv_id, audit, p + 1, at_, CASE WHEN e = 'D' THEN last_ WHEN e = 'K' THEN x ELSE CASE WHEN last_ = 'u' THEN 'a' ELSE 'u' END END,
         CASE WHEN e = 'D' THEN body ELSE body || CASE WHEN last_ = '' THEN '' ELSE chr(10) END
           || CASE WHEN e = 'K' THEN role WHEN last_ = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END
  FROM (SELECT w.conv_id, w.audit, w.p, w.last_, w.body, w.audit[w.p + 1] AS e, w.i + CASE WHEN w.audit[w.p + 1] = 'I' THEN 0 ELSE 1 END AS at_, j.x, j.role, j.text
        FROM walked w LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 AND w.audit[w.p + 1] <> 'I' WHERE w.p < length(w.audit)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(f.cost, 0) AS cost, coalesce(f.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN found f ON o.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN walked w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.p = length(w.audit)""")
def op12_repair_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, messages = repair.repair(damage_turns(rows))
    digests = repair.message_digests(messages).withColumnRenamed("conv_id", "d")
    all_ids = rows.select(F.col("conv_id").alias("id")).distinct()
    joined = all_ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(digests, F.col("id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage_turns(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults planted by the hash of their place: dropped, emptied, unpunctuated, repeated, or all users."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))
    return hit.filter("h != 0").select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language_id.train(docs.filter(~held_out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
