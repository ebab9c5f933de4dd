"""The registered queries of the llm operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bm25, chat, langid, licenses, merkle, mixing, multi_index, ngram_join, periodic, quality, repair, secrets, spm
from quillspark.llm.shared import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again: counts, digests, and whether the text came back."""
    model = spm.read_model(PIECES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = spm.decode(spm.encode(docs, model), model)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(spm.MARK), F.lit(" "))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("decoded_chars"), same.alias("round_trip"), "ids")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80, size=5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"), licenses.TEMPLATES, least=0.8)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.identify(docs, model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        tokenizer = f.read()
    return repair.digests(repair.write_ids(table(spark, sf_dir, "documents"), tokenizer))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages whose id is divisible by 20 as queries, against all documents."""
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return bm25.top_k(table(spark, sf_dir, "documents"), asked, k=10)


def op9_bm25_top_k_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is divisible by 20 as queries, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=None, epochs=1.0, seed=17)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides crc32(doc_id), the row claims one character more than it has."""
    docs = table(spark, sf_dir, "documents")
    return merkle.dataset_proofs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_sentencepiece, op3_quality_rules, op4_ngram_jaccard_join, op5_license_scan, op6_language_id, op7_token_ids, op8_secret_scan, op9_bm25_top_k, op9_bm25_top_k_documents, op10_mix_sources, op11_merkle_manifest, op12_embedding_near_dedup, op13_periodic_runs)}

_ESC = r"replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _tree_sql(name: str, rows: str) -> str:
    """Levels of the trees over rows (g, o, h), n and depth of each g, and the siblings of each level."""
    return f"""
{name}_rows AS ({rows}),
{name}_size AS (SELECT g, count(*) AS n, CASE WHEN count(*) > 1 THEN length(bin(count(*) - 1)) ELSE 0 END AS depth FROM {name}_rows GROUP BY g),
{name}_leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o NULLS FIRST, h) - 1 AS idx FROM {name}_rows),
{name}_level AS (
  SELECT g, 0 AS level, idx, h FROM {name}_leaf
  UNION ALL
  SELECT l.g, l.level + 1, l.idx // 2, sha256(string_agg(l.h, '' ORDER BY l.idx)) FROM {name}_level l JOIN {name}_size s ON s.g IS NOT DISTINCT FROM l.g
  WHERE l.level < s.depth GROUP BY l.g, l.level, l.idx // 2),
{name}_root AS (SELECT l.g, l.h, s.depth FROM {name}_level l JOIN {name}_size s ON s.g IS NOT DISTINCT FROM l.g AND l.level = s.depth),
{name}_way AS (
  SELECT l.g, l.idx, k.level, l.idx >> k.level & 1 AS odd, x.h FROM {name}_leaf l JOIN {name}_size s ON s.g IS NOT DISTINCT FROM l.g, unnest(range(0, s.depth)) k(level)
  LEFT JOIN {name}_level x ON x.g IS NOT DISTINCT FROM l.g AND x.level = k.level AND x.idx = xor(l.idx >> k.level, 1))"""


ORACLES = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE table8 AS (SELECT list(list_reduce([k] || range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(0, 256) r(k)),
crc AS (SELECT doc_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS crc
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), table8),
hashed AS (SELECT d.doc_id, d.lang, sha256({" || ".join(_FIELD.format(c) for c in merkle.FIELDS)}) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256({" || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in merkle.FIELDS)}) END AS claimed
  FROM (SELECT documents.*, crc FROM documents LEFT JOIN crc USING (doc_id)) d),
{_tree_sql("doc", "SELECT lang AS g, doc_id AS o, leaf AS h, claimed FROM hashed").lstrip()},
{_tree_sql("top", "SELECT 1 AS g, g AS o, h FROM doc_root").lstrip()},
way AS (
  SELECT g, idx, level, odd, h FROM doc_way
  UNION ALL
  SELECT l.g, l.idx, s.depth + w.level, w.odd, w.h FROM doc_leaf l JOIN doc_size s ON s.g IS NOT DISTINCT FROM l.g JOIN top_leaf t ON t.o IS NOT DISTINCT FROM l.g JOIN top_way w ON w.idx = t.idx),
fold AS (
  SELECT g, idx, 0 AS level, coalesce(claimed, h) AS h FROM doc_leaf
  UNION ALL
  SELECT f.g, f.idx, f.level + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN odd = 1 THEN w.h || f.h ELSE f.h || w.h END)
  FROM fold f JOIN way w ON w.g IS NOT DISTINCT FROM f.g AND w.idx = f.idx AND w.level = f.level),
folded AS (SELECT g, idx, max_by(h, level) AS h FROM fold GROUP BY g, idx),
proof AS (SELECT g, idx, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS h FROM way GROUP BY g, idx)
SELECT l.o AS doc_id, l.h AS leaf, r.h AS subroot, t.h AS root, coalesce(p.h, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM doc_leaf l JOIN doc_root r ON r.g IS NOT DISTINCT FROM l.g JOIN folded f ON f.g IS NOT DISTINCT FROM l.g AND f.idx = l.idx
LEFT JOIN proof p ON p.g IS NOT DISTINCT FROM l.g AND p.idx = l.idx, top_root t""",
    "op1_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST][/INST]</s>') + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars,
  false AS rewrites
FROM rows GROUP BY conv_id""",
    "op3_quality_rules": quality.rules_sql(),
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
one AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op9_bm25_top_k": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM d),
q AS (SELECT item_id AS query_id, unnest({_WORDS}) AS t FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, t, count(*) AS w FROM q GROUP BY query_id, t),
tf AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY rid, doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT query_id, rid, doc_id, round(sum(qt.w * ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({bm25.K1} + 1)::DOUBLE / (tf + {bm25.K1}::DOUBLE * (1 - {bm25.B}::DOUBLE + {bm25.B}::DOUBLE * tf.n / mean))), 9) AS score
      FROM tf JOIN qt USING (t) JOIN df USING (t), n GROUP BY query_id, rid, doc_id),
r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""",
    "op10_mix_sources": f"""
WITH sums AS (SELECT source, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS BIGINT) AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS total, count(*) AS n FROM sums),
rate AS (SELECT source, 1.0::DOUBLE / n * total / size AS rate FROM sums, total),
steps AS (SELECT source, rate, greatest(CAST(ceil(rate / {mixing.STEP}) AS BIGINT), 1) AS steps FROM rate),
pmf AS (SELECT source, steps, k, exp(-rate / steps + k * ln(rate / steps) - lgamma(k + 1.0)) AS p
        FROM steps, range(0, {mixing.MOST + 1}) r(k)),
cdf AS (SELECT source, steps, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
lists AS (SELECT source, steps, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, steps),
keyed AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY k) AS place
  FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS k FROM documents)),
drawn AS (
  SELECT rid, cdf, (CAST('0x' || substr(md5('17|' || k || '|' || place || '|' || j), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM keyed d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source, unnest(range(1, l.steps + 1)) t(j)),
counts AS (SELECT rid, CAST(sum(len(list_filter(cdf, lambda c: c < u))) AS BIGINT) AS n FROM drawn GROUP BY rid)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.i AS copy_no
FROM keyed d JOIN (SELECT rid, unnest(range(0, n)) AS i FROM counts) c USING (rid)""",
}
ORACLES["op9_bm25_top_k_documents"] = ORACLES["op9_bm25_top_k"].replace("SELECT item_id AS query_id", "SELECT doc_id AS query_id").replace("FROM benchmark WHERE item_id % 20 = 0", "FROM documents WHERE doc_id % 20 = 0")
