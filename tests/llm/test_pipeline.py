from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from batchloom.plans import settle
from pyspark.sql import functions as F

from tests.llm.common import DOCS, edited, prose, rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(60, 120)) for _ in range(60)]
    passage = prose(rng, 55)
    item = " ".join(f"b{rng.randrange(10**5)}" for _ in range(40))
    texts[10] += " " + passage
    texts[11] += " " + passage
    texts[12] += " " + item
    texts += [edited(rng, texts[1], 3), texts[2]]
    junk = [" ".join(w + "%%%" for w in prose(rng, 50).split()) for _ in range(30)]
    made = rows(texts + junk)
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(made, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 62)) for i in range(92) if i % 2], "doc_id bigint, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), [r[1] for r in made]


def test_every_stage_decides(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.cut(stage(spark, docs, at))
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, apart, cut, clean = kept
    assert set(good) == set(range(62))
    assert set(apart) == set(range(60))
    assert set(cut) == set(range(60)) and {i for i in cut if cut[i] != texts[i]} == {11} and len(cut[11].split()) == len(texts[11].split()) - 55
    assert set(clean) == set(range(60)) - {12}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.n_words
    assert total == {i: len(t.split()) for i, t in clean.items()}
    assert sorted(map(str, corpus_pipeline.run(spark, at).collect())) == sorted(map(str, packed))


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "substring dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_take_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_stages_take_awkward_rows(spark, tmp_path):
    """Null, blank and very long texts, repeated rows, missing ids, a column of a clashing name, and no labels or benchmark."""
    rng = random.Random(5)
    long = prose(rng, 400_000, 10**8)
    plain = prose(rng, 80)
    texts = [None, "", " \n ", "one", long, plain, plain + " ", plain]
    ids = [0, 1, 2, 3, 4, 5, 6, None]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in zip(ids, texts)] + [(4, long, "en", "s", 1)], DOCS).withColumn("written", F.lit("w")).withColumn("group_id", F.lit(1))
    empty_labels, empty_items = f"{tmp_path}/labels.parquet", f"{tmp_path}/benchmark.parquet"
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(empty_labels)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(empty_items)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns[-2:] == ["written", "group_id"]
        seen.append(sorted(str(r.doc_id) for r in docs.collect()))
    good, apart, cut, clean = seen
    assert good == ["3", "4", "4", "5", "6", "None"]
    assert apart == ["3", "4", "4", "5", "None"]  # the copy goes, the row without an id stays
    assert cut == clean == apart
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.n_words for r in packed) == 1 + 2 * 400_000 + 80 + 80


def test_a_run_leaves_one_table(spark, folder):
    at = Path(settle.folder(spark).removeprefix("file://"))
    before = set(at.iterdir()) if at.exists() else set()
    corpus_pipeline.run(spark, folder[0]).count()
    assert len(set(at.iterdir()) - before) == 1
