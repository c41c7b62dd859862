"""The pipeline against plain versions of its stages, each on its own input."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from placeweave.llm import line_rules, toxicity
from tests.llm.test_documents import check_packing, classes_by_brute_force

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        result = function(spark, docs, FOLDER)
        if k < 3:
            assert result.columns == columns
        result.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    judged = {r.doc_id: line_rules.judge(r.text) for r in source}
    expected = {k: v[-1] for k, v in judged.items() if v[-2]}
    assert {r.doc_id: r.text for r in kept[0]} == expected
    assert all(r.n_chars == len(r.text) for r in kept[0])

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    clean = {r.doc_id for r in labels if r.toxic == 0} & set(expected)
    assert len(clean - {r.doc_id for r in kept[1]}) <= 0.02 * len(clean)

    classes = classes_by_brute_force({r.doc_id: r.text for r in kept[1]}, 5)[1]
    assert {r.doc_id for r in kept[2]} == set(classes.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[2]}
    packed = {}
    for r in kept[3]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == lengths
    # The sum of the lengths is a bound that no packing need reach.
    assert check_packing(kept[3], 4096) <= -(-int(np.sum(list(lengths.values()))) // 4096) + 1
    run = __spark_entry__.queries()["pipeline"](spark, FOLDER)
    assert {(r.doc_id, r.piece, r.length) for r in run.collect()} == {
        (r.doc_id, r.piece, r.length) for r in kept[3]
    }


def test_toxicity_stage_on_held_out_labels(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.quality_rules(spark, docs, folder).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(toxicity.held_out(F.col("doc_id")))
    held = labels.join(docs.select("doc_id"), "doc_id").collect()
    clean = {r.doc_id for r in held if r.toxic == 0}
    toxic = {r.doc_id for r in held if r.toxic == 1}
    # Of 83 toxic rows 67 went when this was written; the model misses the others.
    assert len(clean) >= 100 and len(toxic) >= 20
    assert len(clean - kept) <= 0.02 * len(clean)
    assert len(toxic & kept) <= 0.25 * len(toxic)


def test_odd_documents_and_empty_tables(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [r.text for r in corpus_pipeline.quality_rules(spark, table, FOLDER).orderBy("doc_id").limit(40).collect()]
    classes = classes_by_brute_force(dict(enumerate(texts)), 5)[1]
    one, two, three = [texts[k] for k, least in classes.items() if k == least][:3]
    rows = [(1, one), (1, one), (2, one), (None, two), (3, None), (4, ""), (5, three)]
    docs = spark.createDataFrame(
        [(k, t, None, None, None, "more") for k, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, kept string",
    )
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0)
    for name, part in (("odd", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        part.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        # A copy goes, rows of one doc_id and those without one stay; texts without words go.
        expected = [1, 1, 5, None] if name == "odd" else []
        firsts = [r.doc_id for r in found if r.piece == 0]
        assert sorted(firsts, key=str) == sorted(expected, key=str)
