"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.llm import bytebpe, chat, decontaminate, divergence, fuzzylines, lexsearch, maintext, neardup, quality, sampling, secret_scan, substrings, tokenfiles, toxicity, words
from headroom.sources.staging import fresh_path

#: Rank file of the byte-level BPE query; every executor reads it from its own installation.
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Tokenizer file of the token-file query, read the same way.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    words.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str) -> F.Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = toxicity.train(sampling.labelled_sample(docs, labels, "toxic", toxicity.SAMPLE_ROWS))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("row")).select("row.*")
    out = chat.format_conversations(rows.unionByName(extra))
    read = out.select("conv_id", chat.formatted_text().alias("formatted"), chat.loss_text().alias("loss"))
    read = read.withColumn("turns", chat.parse(F.col("formatted")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, WORD_BPE, end=2)
    return tokenfiles.summary(spark, folder)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_repeats(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fuzzylines.dedup_lines(docs, removed="n_removed")
    kept = F.coalesce("text", F.lit(""))
    n_kept = F.size(F.filter(F.split(kept, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return out.select("doc_id", (n_kept + F.col("n_removed")).alias("n_lines"), "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bytebpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.train(pages))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_token_files": op5_token_files,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_html_extraction": op13_html_extraction,
}

ORACLE: dict[str, str] = {}

ORACLE["op9_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS run
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS pos
        FROM item WHERE len(w) > 0)),
places AS (
  SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS pos
        FROM doc, (SELECT DISTINCT size FROM windows))),
hits AS (SELECT doc_id, pos, size, item_id FROM places JOIN windows USING (size, run)),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

ORACLE["op4_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + length('<s>[INST][/INST]</s>')
      + len(regexp_extract_all(role || chr(0) || text, '<\\*/?s>|\[\\*/?INST\]')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE["op7_substring_dedup"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (
  SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS run
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS pos FROM doc)),
least AS (SELECT run, min(doc_id) AS least FROM places GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, k
  FROM (SELECT doc_id, unnest(generate_series(pos, pos + 12)) AS k FROM places JOIN least USING (run) WHERE doc_id > least)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS k FROM doc),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept, count(*) AS n_kept
  FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

ORACLE["op11_source_divergence"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
word AS (SELECT id, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term),
member AS (SELECT DISTINCT lang, source FROM doc),
size AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
dense AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(o.n, 0) + s.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.total + 1) // (s.n + s.v)::HUGEINT AS q
  FROM member m JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN own o USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM member a JOIN member b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

ORACLE["op12_ranked_search"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS place, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS repeats FROM item GROUP BY item_id, term),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS len FROM doc WHERE len(w) > 0),
posting AS (
  SELECT place, doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT place, doc_id, len(w) AS n, unnest(w) AS term FROM doc) GROUP BY place, doc_id, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM posting, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (
  SELECT item_id, place, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term), total GROUP BY item_id, place, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
