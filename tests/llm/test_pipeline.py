"""Every stage of the pipeline on odd rows, and run() end to end."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, copies int, first string, shard int"


def frame(spark, rows):
    """(doc_id, text, source) with the other columns of documents, and some whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, 2, "x", 3) for d, t, s in rows], SCHEMA).repartition(3)


def texts(rows):
    return sorted(((r.doc_id, r.text) for r in rows.collect()), key=str)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_table_and_columns(spark, stage):
    out = stage(spark, frame(spark, []), SF)
    assert out.count() == 0
    if stage is not corpus_pipeline.write_ids:
        assert out.columns == frame(spark, []).columns


def test_near_copies_without_or_with_equal_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    edited = one.replace("a30", "other")
    rows = [(None, one, "s"), (None, one, "s"), (7, two, "s"), (7, two, "s"), (7, "quite another text under this id", "s"), (5, edited, "s"), (None, None, "s"), (3, "", "s"), (None, " ", None)]
    assert texts(corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), SF)) == sorted([(5, edited), (7, two), (7, "quite another text under this id"), (3, "")], key=str)


def test_leaks_without_or_with_equal_ids(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).collect())
    clean = "a clean text of no benchmark " * 3
    rows = [(None, item, "s"), (4, f"lead {item} end", "s"), (4, clean, "s"), (4, clean, "s"), (None, None, "s"), (5, "", "s"), (6, "word " * 200_000 + item, "s")]
    assert texts(corpus_pipeline.drop_leaks(spark, frame(spark, rows), SF)) == sorted([(4, clean), (4, clean), (None, None), (5, "")], key=str)


def test_toxicity_judges_equal_texts_alike(spark):
    rows = [(None, "you worthless pathetic scum, you disgusting idiot, what a moron and loser", "s"), (1, "you worthless pathetic scum, you disgusting idiot, what a moron and loser", "s"), (2, None, "s"), (2, "", "s"), (None, "a fine day " * 50_000, "s")]
    kept = texts(corpus_pipeline.drop_toxic(spark, frame(spark, rows), "/root/testdata/sf0.01"))
    assert kept == sorted([(2, None), (2, ""), (None, "a fine day " * 50_000)], key=str)




def test_mix_meets_its_quotas_by_whole_documents(spark):
    source = random.Random(1)
    rows = [(None if i % 5 == 0 else i % 7 if i % 5 == 1 else i, f"w{i} " * source.randint(0, 300), "hot" if i % 3 else ["a", "ü", None][i % 4 % 3]) for i in range(1500)] + [(1, "same words", "a")] * 40
    docs = frame(spark, rows)
    aims = {r.source: (r.target, r.source_size) for r in mixing.mix(docs).select("source", "target", "source_size").distinct().collect()}
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    taken, times = {}, {}
    for r in got.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        times[(r.doc_id, r.text, r.source)] = times.get((r.doc_id, r.text, r.source), 0) + 1
    longest = max(len((t or "").split()) for _, t, _ in rows)
    assert set(taken) == {s for s, (t, _) in aims.items() if t > mixing.BLOCK} and all(abs(taken[s] - aims[s][0]) <= longest / 2 + mixing.BLOCK for s in taken)
    there = {}
    for row in rows:
        there[row] = there.get(row, 0) + 1
    assert all(n <= 2 * there[row] for row, n in times.items())
    assert texts(got) == texts(corpus_pipeline.mix_sources(spark, docs.repartition(7), SF))


def test_run_end_to_end(spark):
    """The last stage's rows are those of the stages applied one by one, and ids are those of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns
        counts.append(rows.count())
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert len(out) == counts[-1] and [r.doc_id for r in out] == sorted(r.doc_id for r in rows.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:])) and out[0].start == 0
