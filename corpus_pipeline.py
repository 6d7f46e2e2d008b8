"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, with whatever other columns
docs has. Every row is judged by itself: stages that compare rows know them by id and text, so that rows without an id, or
with one that others have, are treated like any other. An empty table gives an empty result in every stage. Tables that
only lead to a stage's decisions are deleted once those are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import decontamination, mixing, near_copies, token_frames, toxicity
from rosterlake.llm.common import staged
from rosterlake.llm.queries import table, tokenizer_path, toxicity_model
from rosterlake.staging import delete, new_folder, passing

#: What tells rows apart here, besides the columns of docs; columns of these names in docs would clash.
KEY = ["__id__", "__text__"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY: the id, and XXH64 of the text, null like empty. Rows of one key are copies under one id, or none."""
    return docs.withColumns({"__id__": F.col("doc_id").cast("long"), "__text__": F.xxhash64(F.coalesce("text", F.lit("")))})


def same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def those_in(docs: DataFrame, keys: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of docs whose columns are in keys, nulls like values; or, left_anti, those whose aren't."""
    return docs.alias("d").join(keys.alias("k"), same("d", "k", columns), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half.

    Null and empty texts have no hit and stay. Equal texts have equal scores, whatever their ids; very long ones are
    scored whole. Without enough labels the operator's fixed list judges."""
    with passing(spark):
        model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word Jaccard 0.8 or more; op8's own parameters, three words and
    three bits, are its contract alone): the one of the smallest doc_id, null last, then of the smallest text hash.

    Null, empty and blank texts are copies of each other: one stays. Equal rows are copies, with or without ids. Texts
    are known by their hash, and what is kept of them by hash and id, so no numbered copy of the corpus is written."""
    with passing(spark):
        rows = keyed(docs)
        counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
        groups = near_copies.near_copies(rows.select(F.col("__text__").alias("doc_id"), "text")).select(F.col("doc_id").alias("__text__"), "component_id").distinct()
        first = F.min(F.struct(F.col("__id__").isNull().alias("none"), *KEY, "rows")).alias("first")
        kept = counts.join(staged(groups, "groups"), "__text__").groupBy("component_id").agg(first).select("first.*")
        kept = staged(kept, "kept", lasting=True)
    single = those_in(rows, kept.where("rows = 1"), KEY)
    several = those_in(rows, kept.where("rows > 1"), KEY).dropDuplicates(KEY)
    return single.unionByName(several).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged by their texts alone; null and empty texts hold none.

    As equal texts are judged alike, rows are known by XXH64 of their texts here."""
    rows = keyed(docs)
    with passing(spark):
        texts = rows.where("text is not null").select(F.col("__text__").alias("doc_id"), "text")
        leaks = decontamination.contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__text__")).distinct()
        leaks = staged(leaks, "leaks", lasting=True)
    return rows.join(leaks, "__text__", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: the quotas of mixing, met by whole documents.

    Reruns agree but for which of several equal rows is meant. Rows without words stay out: the mix takes nothing of
    them, whatever their source's target. A very long document is taken whole or not at all."""
    own = [*KEY, "__source__"]
    rows = keyed(docs).withColumn("__source__", F.col("source").cast("string"))
    several = staged(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "several", lasting=True)
    # Only rows that others equal need a number to be told apart: those are written with it.
    equal = staged(those_in(rows, several, own).withColumn("__row__", F.monotonically_increasing_id()), "equal", lasting=True)
    rows = those_in(rows, several, own, "left_anti").withColumn("__row__", F.lit(None).cast("long")).unionByName(equal)
    with passing(spark):
        told = rows.withColumn("__key__", F.struct(*own, "__row__"))
        copies = mixing.whole_copies(told, "__key__").where("copies > 0").select("__key__.*", F.col("copies").alias("__copies__"))
        copies = staged(copies, "copies", lasting=True)
    each = F.explode(F.sequence(F.lit(1), "__copies__"))
    return rows.alias("d").join(copies.alias("k"), same("d", "k", [*own, "__row__"])).select("d.*", "k.__copies__").withColumn("__copy__", each).select(*docs.columns)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of every document: doc_id, start, n_tokens, ids_crc32. Rows of equal or no ids are
    documents each, null and empty texts just the end id, other columns ignored; see token_frames.write_tokens."""
    return token_frames.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", keep_one_of_each), ("benchmark_decontamination", drop_leaks), ("mixing", mix_sources), ("token_output", write_ids)]

#: Learned weights, XXH64 fingerprints, graph components, seeded hashes and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage has read is deleted once its own rows are written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if read:
            delete(spark, read)
        read = folder
    return docs
