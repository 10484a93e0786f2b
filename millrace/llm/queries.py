"""The corpus operators as registered queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, langid, licenses, packing, quality, secrets, syncmers, toxicity, warc
from millrace.llm._tables import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the contract: spans of the models, the tokens they judged, and their log-likelihood ratio of each base span's secret."""
    docs = table(spark, sf_dir, "documents")
    models = secrets.train(secrets.labelled_samples(spark, docs))
    out = secrets.scan(docs, models, ["doc_id", "text"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.told(F.col("base")), 256).alias("base_sha256"), secrets.told(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_random"), F.size("judged").cast("long").alias("n_judged"), F.array_join(secrets.evidence(F.coalesce("text", F.lit("")), F.col("base"), models).cast("array<string>"), ",").alias("base_ratios"),
    )


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the contract: whether a page's record came back from, or lay in a gap of, archives damaged as ``warc.hurts`` says."""
    back = warc.round_trip(table(spark, sf_dir, "pages")).filter(F.col("kind") == "record")
    return back.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"), "recovered", "quarantined")


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.placed(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain: junk (low quality), toxic, abusive junk (both); ``toxic`` from the threshold of best out-of-fold F1 up."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    junk = F.when(F.col("quality").isNotNull(), (F.col("quality") < 1).cast("double"))
    labels = labels.select("doc_id", junk.alias("junk"), F.col("toxic").cast("double").alias("toxic"), F.least(junk, F.col("toxic")).alias("abusive_junk"))
    chain = toxicity.fit(docs, labels, ["junk", "toxic", "abusive_junk"])
    return toxicity.predict(docs, chain).withColumn("toxic", (F.col("p_toxic") >= chain.thresholds[1]).cast("int"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_secret_scan": op2_secret_scan,
        "op3_warc_salvage": op3_warc_salvage,
        "op4_closed_syncmers": op4_closed_syncmers,
        "op5_license_scan": op5_license_scan,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_toxicity_chain": op7_toxicity_chain,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_salvage": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            f AS (SELECT page_id, h, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
            SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
                   CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to,
                   page_id % 10 <> 3 AS recovered, page_id % 10 = 3 AS quarantined
            FROM f
        """,
        "op5_license_scan": licenses.oracle_sql(),
        "op6_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
            l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
            c AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.d)
            SELECT d AS doc_id, min(r) AS class_id, (SELECT count(*) FROM l WHERE l.a = d) AS n_links FROM c GROUP BY d
        """,
        "op9_benchmark_decontamination": r"""
            WITH i0 AS (SELECT item_id, trim(text) AS text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
            i AS (SELECT *, len(ws) AS n, CASE WHEN regexp_matches(text, '[.?!:]\s+') THEN regexp_extract(text, '(?s)^(.*[.?!:]\s+)', 1) ELSE array_to_string(string_split(text, ' ')[:len(string_split(text, ' ')) - len(string_split(text, ' ')) // 3], ' ') END AS q FROM i0),
            h AS (SELECT item_id, part, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS ws FROM (SELECT item_id, 'q' AS part, q AS body FROM i UNION ALL SELECT item_id, 'a', substring(text, length(q) + 1) FROM i)),
            hg AS (SELECT DISTINCT item_id, part, least(3, len(ws)) AS m, unnest([array_to_string(ws[j:j + least(3, len(ws)) - 1], ' ') FOR j IN range(1, len(ws) - least(3, len(ws)) + 2)]) AS g FROM h WHERE len(ws) > 0),
            hn AS (SELECT item_id, part, count(*) AS total FROM hg GROUP BY ALL),
            tf AS (SELECT item_id, n, w, count(*) AS tf FROM (SELECT item_id, n, unnest(ws) AS w FROM i) GROUP BY ALL),
            st AS (SELECT count(*) AS items, avg(n) AS mean, greatest(32, max(n)) AS half FROM i),
            df AS (SELECT w, ln(1 + (any_value(items) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY w),
            wt AS (SELECT item_id, w, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS weight FROM tf JOIN df USING (w), st),
            self AS (SELECT item_id, sum(weight) AS whole FROM wt GROUP BY item_id),
            d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
            win AS (SELECT doc_id, k * half AS first, ws[k * half + 1:(k + 2) * half] AS ws FROM (SELECT doc_id, ws, half, unnest(range(0, greatest(1, CAST(ceil(len(ws) / half) AS BIGINT) - 1))) AS k FROM d, st)),
            hit AS (SELECT doc_id, first, item_id, sum(weight) / any_value(whole) AS score FROM (SELECT DISTINCT doc_id, first, unnest(ws) AS w FROM win) JOIN wt USING (w) JOIN self USING (item_id) GROUP BY ALL HAVING sum(weight) >= 0.6 * any_value(whole) - 1e-6),
            has AS (SELECT doc_id, first, item_id, round(score, 9) AS score, part, count(*) FILTER (contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || g || ' ')) / any_value(total) AS share
                    FROM hit JOIN win USING (doc_id, first) JOIN hg USING (item_id) JOIN hn USING (item_id, part) GROUP BY ALL),
            both_ AS (SELECT doc_id, item_id, score, first, coalesce(max(share) FILTER (part = 'q'), max(share)) AS q, coalesce(max(share) FILTER (part = 'a'), max(share)) AS a FROM has GROUP BY ALL)
            SELECT doc_id, item_id, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap, first AS first_word FROM both_ WHERE q >= 0.5 AND a >= 0.5
            QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, q DESC, a DESC, first) = 1
        """,
    }
