"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtokens, bpe, chat, decontam, fim, hosts, langid, linededup, media, pii, quality, resample, simhash
from .common import table


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(table(spark, sf_dir, "documents"))


def op3_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowtokens.tokens_to_arrow(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and labels share their ids: a page's outcome is bad if its label is low or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return hosts.judge(table(spark, sf_dir, "pages"), outcomes)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


#: What both turns of the conversation say that is added: markers of this template and of others.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more with control strings in its texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.windows(turns.union(more)))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_media_jpeg, op3_arrow_tokens, op4_quality, op5_host_reputation, op6_simhash, op7_pii, op8_line_dedup, op9_decontaminate, op10_language_id, op11_fill_in_middle, op12_resample, op13_chat_format)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _strength_sql(groups: str, m: str) -> str:
    low, high = hosts.STRENGTH
    spread = f"sum(pow(bad / n::DOUBLE - {m}, 2) * n) / sum(n)"
    within, size = f"sum({m} * (1 - {m}) * n) / sum(n)", "(sum(n)::DOUBLE / count(*))"
    return f"SELECT coalesce(CASE WHEN {spread} <= ({within}) / {size} THEN {high} ELSE least(greatest((({within}) - {spread}) / ({spread} - ({within}) / {size}), {low}), {high}) END, {high})::DOUBLE AS s FROM {groups}"


_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in sorted(hosts.RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in hosts.RULES) + " ELSE method END"
_TWO = ", ".join(f"'{x}'" for x in hosts.TWO_LABEL_SUFFIXES)
_LAST = lambda k: f"array_to_string(list_slice(string_split(host, '.'), -{k}, -1), '.')"

ORACLES: dict[str, str] = {
    "op5_host_reputation": f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, {_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
o AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
hosts AS (SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad, CASE WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain, CASE WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix FROM p LEFT JOIN o USING (page_id) GROUP BY host),
seen AS (SELECT * FROM hosts WHERE n > 0),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM seen GROUP BY 1), m0 AS (SELECT coalesce(sum(bad) / sum(n)::DOUBLE, 0) AS m0 FROM s1), s1m AS (SELECT * FROM s1, m0), k1 AS ({_strength_sql("s1m", "m0")}),
p1 AS (SELECT suffix, (s * m0 + bad) / (s + n) AS m1 FROM s1m, k1),
s2 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(m1) AS m1 FROM seen JOIN p1 USING (suffix) GROUP BY 1, 2), k2 AS ({_strength_sql("s2", "m1")}),
p2 AS (SELECT domain, (s * m1 + bad) / (s + n) AS m2 FROM s2, k2),
s3 AS (SELECT n, bad, m2 FROM seen JOIN p2 USING (domain)), k3 AS ({_strength_sql("s3", "m2")}),
ab AS (SELECT host, s * coalesce(m2, m1, m0) + bad AS a, s * (1 - coalesce(m2, m1, m0)) + n - bad AS b FROM hosts LEFT JOIN p2 USING (domain) LEFT JOIN p1 USING (suffix), m0, k3),
v AS (SELECT host, CASE WHEN round(a / (a + b) - {hosts.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) > {hosts.THRESHOLD} THEN 'block' ELSE 'allow' END AS method FROM ab),
r AS (SELECT page_id, host, path, {_RULE} AS rule, method FROM p JOIN v USING (host))
SELECT page_id, host, path, rule, {_VERDICT} AS verdict FROM r""",
    "op8_line_dedup": f"""WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM d),
k AS (SELECT *, trim(translate(line, chr(9) || chr(13), '  ')) AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
m AS (SELECT doc_id, line, place, first IS NOT NULL AND first <> doc_id AS gone FROM k LEFT JOIN s USING (key)),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS text FROM m GROUP BY 1)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t.text, '')) AS text_sha256 FROM documents LEFT JOIN t USING (doc_id)""",
    "op9_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {decontam.WINDOW}) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, n, w[s : s + n - 1] AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
dw AS (SELECT doc_id, s, n, w[s : s + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (n, x)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_fill_in_middle": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('{fim.SEED}:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - fim.PLAIN_PERCENT} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM x""",
    "op12_resample": f"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
d AS (SELECT doc_id AS id, 1 AS side, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents UNION ALL SELECT item_id, 2, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
o AS (SELECT id, side, unnest(w) AS word FROM d),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM o)),
b AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % {resample.BUCKETS} AS bucket FROM v, crc),
n AS (SELECT id, side, bucket FROM o JOIN b USING (word)),
g AS (SELECT bucket, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM n GROUP BY 1),
k AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM g) + {resample.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM g) + {resample.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM g),
w AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM n JOIN k USING (bucket) WHERE side = 1 GROUP BY 1),
h AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w ON id = doc_id),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= {resample.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {resample.PERCENT} * count(*) // 100 FROM r) THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)""",
    "op13_chat_format": f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.TURN_TOKENS} AS tokens, length(text) + len(regexp_extract_all(text, '</?turn')) + length(role) + {len("<turn >") + 1 + len(chat.LAST)} AS chars FROM c),
h AS (SELECT conv_id, tokens AS system_tokens, chars AS system_chars FROM o WHERE pos = 1 AND role = 'system'),
a AS (SELECT o.*, coalesce(system_tokens, 0) AS sys, coalesce(system_chars, 0) AS sys_chars, sum(tokens) OVER (PARTITION BY o.conv_id ORDER BY pos) - coalesce(system_tokens, 0) AS after FROM o LEFT JOIN h USING (conv_id)),
b AS (SELECT *, greatest(after - tokens, 0) AS before, greatest(after - 1, 0) // {chat.FRESH} AS span FROM a),
s AS (SELECT *, before < span * {chat.FRESH} AND max(after) OVER w - min(before) OVER w > {chat.FRESH} AS alone FROM b WINDOW w AS (PARTITION BY conv_id, span)),
w AS (SELECT conv_id, span, alone, min(pos) AS start, min(before) AS f, max(after) AS t, any_value(sys) AS sys, any_value(sys_chars) AS sys_chars, sum(chars) AS chars FROM s GROUP BY 1, 2, 3),
e AS (SELECT w.conv_id, w.start, sum(s.chars) AS chars FROM w JOIN s ON s.conv_id = w.conv_id AND s.after > 0 AND s.after <= w.f AND s.before >= w.f - least({chat.HISTORY}, greatest({chat.BUDGET} - w.sys - (w.t - w.f), 0)) GROUP BY 1, 2),
z AS (SELECT w.conv_id, sum(w.chars + coalesce(e.chars, 0) + CASE WHEN w.start > 1 THEN w.sys_chars ELSE 0 END)::BIGINT AS formatted_chars FROM w LEFT JOIN e USING (conv_id, start) GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars FROM c JOIN z USING (conv_id) GROUP BY 1""",
}
