"""The operators' registered queries, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, filter_audit, kd_shards, licences, mixing, periodic_runs, pii, simhash, substring_dedup, token_frames, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), list(url_filters.RULES))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS]
    everything = F.array_sort(F.concat("base", "extra"))
    return rows.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(everything).alias("spans"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


def op11_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.rolled(table(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (
        op1_substring_dedup, op2_url_filters, op3_pii, op4_token_output, op5_license_scan, op6_toxicity, op7_mixing, op8_simhash, op9_decontamination, op10_ann,
        op11_kd_sharding, op12_filter_audit, op13_periodic_runs, pipeline,
    )
    return {f.__name__: f for f in own}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": f"""
            WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
            starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM docs),
            windows AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w FROM starts),
            ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE n > 1),
            flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM docs),
            kept AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.j) FILTER (WHERE g.j IS NULL) AS t, count(g.j) AS n
                     FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.j = g.j GROUP BY f.doc_id)
            SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
            FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
        "op2_url_filters": r"""
            WITH parts AS (
              SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
            split AS (
              SELECT page_id,
                translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
              FROM parts),
            rules(rule, host, path, verdict) AS (VALUES
              ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
              ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
            fits AS (
              SELECT s.page_id, s.host, s.path, r.rule, r.verdict, length(r.rule) AS n
              FROM split s LEFT JOIN rules r ON ('.' || s.host) LIKE ('%.' || r.host) AND starts_with(s.path, r.path))
            SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, n) AS rule, coalesce(arg_max(verdict, n), 'allow') AS verdict
            FROM fits GROUP BY page_id""",
        "op12_filter_audit": f"""
            WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
            tags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
            first AS (SELECT t, min(doc_id) AS doc_id FROM docs GROUP BY t),
            fails AS (SELECT d.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
                (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                + 4 * (100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t))::INT
                + 8 * regexp_matches(d.t, '[#$%&*|]')::INT + 16 * coalesce(f.doc_id < d.doc_id, false)::INT AS mask
                FROM docs d JOIN first f ON f.t = d.t LEFT JOIN tags g ON g.doc_id = d.doc_id),
            masks AS (SELECT part, mask, good, toxic, count(*)::BIGINT AS n FROM fails GROUP BY ALL),
            letter(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
            orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letter a, letter b, letter c, letter d, letter e
                WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
            steps AS (SELECT o, s::INT AS s, bits[s] AS own, list_sum(bits[:s - 1])::INT AS before FROM orders, range(1, 6) r(s)),
            counted AS (SELECT part, o, s, own,
                sum(n) FILTER (WHERE mask & (own | coalesce(before, 0)) = 0) AS kept,
                sum(n) FILTER (WHERE mask & own > 0 AND mask & coalesce(before, 0) = 0) AS removed,
                sum(n) FILTER (WHERE mask & own > 0 AND mask & coalesce(before, 0) > 0) AS redundant,
                sum(n) FILTER (WHERE mask = own) AS unique_fails,
                sum(n) FILTER (WHERE mask & own > 0 AND mask & coalesce(before, 0) = 0 AND good) AS good_lost,
                sum(n) FILTER (WHERE mask & own > 0 AND mask & coalesce(before, 0) = 0 AND toxic) AS toxic_lost
                FROM masks, steps GROUP BY ALL)
            SELECT part, o AS filter_order, s AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
                coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
                coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM counted""",
    }
