"""The thin ``opN_`` queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import class_lm, crf_lang, decontaminate, dual_tree, harmonic, ngram_join, piecewise_hash, preference, quality_cascade, secret_scan, token_shards, transducer, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    _, manifest = token_shards.write_shards(docs, BYTE_BPE, end_id=0)
    found = token_shards.fetch(manifest, docs, "doc_id").unionByName(token_shards.without_key(manifest))
    return found.withColumnRenamed("key", "doc_id")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(_documents(spark, sf_dir), size=3, num=90, den=100)
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.against_next(_documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = preference.answered_otherwise(conversations)
    learned = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    size = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return made.select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), *(f(c) for c in ("prompt", "chosen", "rejected") for f in (size, digest)),
        learned(F.col("chosen_mask")).alias("chosen_learned"), learned(F.col("rejected_mask")).alias("rejected_learned"),
    )


OP4_SQL = r"""
WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
e AS (SELECT c.conv_id, turn, coalesce(role, '') AS role, role AS r0, coalesce(text, '') AS text, text AS t0, last FROM conversations c JOIN l USING (conv_id) WHERE turn <= last),
n AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next FROM l),
y AS (SELECT n.conv_id, role, r0, text, t0 FROM e JOIN n ON e.conv_id = n.next WHERE n.next <> n.conv_id AND turn = last AND r0 = 'assistant'),
ids AS (SELECT DISTINCT conv_id FROM y JOIN l USING (conv_id)),
c AS (SELECT conv_id, turn, role, r0, text, t0 FROM e JOIN ids USING (conv_id)),
r AS (SELECT conv_id, turn, role, r0, text, t0 FROM e JOIN ids USING (conv_id) WHERE turn < last UNION ALL SELECT conv_id, last, role, r0, text, t0 FROM y JOIN l USING (conv_id)),
ct AS (SELECT conv_id, turn, list((r0, t0) ORDER BY r0 NULLS FIRST, t0 NULLS FIRST) AS m, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY r0 NULLS FIRST, t0 NULLS FIRST) AS s, CAST(sum(CASE WHEN r0 = 'assistant' THEN length(text) + 8 ELSE 0 END) AS BIGINT) AS k FROM c GROUP BY ALL),
rt AS (SELECT conv_id, turn, list((r0, t0) ORDER BY r0 NULLS FIRST, t0 NULLS FIRST) AS m, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY r0 NULLS FIRST, t0 NULLS FIRST) AS s, CAST(sum(CASE WHEN r0 = 'assistant' THEN length(text) + 8 ELSE 0 END) AS BIGINT) AS k FROM r GROUP BY ALL),
j AS (SELECT conv_id, turn, ct.s AS cs, rt.s AS rs, ct.k AS ck, rt.k AS rk, ct.m IS NOT DISTINCT FROM rt.m AS same FROM ct FULL JOIN rt USING (conv_id, turn)),
d AS (SELECT *, coalesce(turn < min(CASE WHEN NOT same THEN turn END) OVER (PARTITION BY conv_id), true) AS p FROM j),
g AS (SELECT conv_id, CAST(count(*) FILTER (p) AS BIGINT) AS prompt_turns, coalesce(string_agg(cs, '' ORDER BY turn) FILTER (p), '') AS prompt,
      coalesce(string_agg(cs, '' ORDER BY turn) FILTER (NOT p), '') AS chosen, coalesce(string_agg(rs, '' ORDER BY turn) FILTER (NOT p), '') AS rejected,
      CAST(coalesce(sum(ck) FILTER (NOT p), 0) AS BIGINT) AS chosen_learned, CAST(coalesce(sum(rk) FILTER (NOT p), 0) AS BIGINT) AS rejected_learned FROM d GROUP BY conv_id)
SELECT conv_id, prompt_turns, length(prompt) AS prompt_chars, sha256(prompt) AS prompt_sha256, length(chosen) AS chosen_chars, sha256(chosen) AS chosen_sha256,
       length(rejected) AS rejected_chars, sha256(rejected) AS rejected_sha256, chosen_learned, rejected_learned FROM g
"""


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secret_scan.scan(docs, secret_scan.fit(docs)).withColumnRenamed("key", "doc_id")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = class_lm.score(docs, ~held_out).withColumnRenamed("key", "doc_id")
    return scored.withColumn("held_out", held_out)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = harmonic.pack(_documents(spark, sf_dir), BYTE_BPE, end_id=1, capacity=2048)
    return packed.withColumnRenamed("key", "doc_id")


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = crf_lang.fit(docs, ~held_out)
    found = crf_lang.predict(docs, model).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality_cascade.scored(_documents(spark, sf_dir).select("doc_id", "text"), prefix="")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    lexicon = transducer.build_lexicon(docs, WORD_BPE)
    return transducer.digests(docs, WORD_BPE, lexicon).withColumnRenamed("key", "doc_id")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n FROM rep GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 40 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, CAST(least(10, len(w)) AS INTEGER) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
x AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM g) ON len(w) >= n)),
h AS (SELECT r, k, x.n, item_id FROM x JOIN g ON x.n = g.n AND x.s = g.s),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM h) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return dual_tree.mine(rows, F.col("vec_id") % 50 == 0, label=label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model)
    shares = F.array(*(F.lit(float(x)) for x in model.explained)).cast("array<double>")
    return whitening.transform(rows, model).select(
        F.col("key").alias("vec_id"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        F.posexplode("whitened").alias("__at", "whitened"),
    ).select(
        "vec_id", (F.col("__at") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("__at")).alias("explained"), F.lit(error).alias("identity_error")
    )


def queries() -> dict:
    return {"op1_token_shards": op1_token_shards, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_fingerprints": op3_fingerprints, "op4_preference_pairs": op4_preference_pairs, "op5_secret_scans": op5_secret_scans, "op6_class_lm": op6_class_lm, "op7_harmonic_packing": op7_harmonic_packing, "op8_crf_language": op8_crf_language, "op9_quality_rules": op9_quality_rules, "op10_transducer_bpe": op10_transducer_bpe, "op11_decontamination": op11_decontamination, "op12_hard_negatives": op12_hard_negatives, "op13_whitening": op13_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op4_preference_pairs": OP4_SQL, "op9_quality_rules": OP9_SQL, "op11_decontamination": OP11_SQL}
