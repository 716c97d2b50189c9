"""The pipeline on a small corpus with planted cases, and each stage alone."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, small, duck, tmp_path_factory):
    """The small tables with more documents: copies, near copies, repeated windows, passages, junk."""
    at = tmp_path_factory.mktemp("corpus")
    other = duck.execute("SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'en' AND length(text) BETWEEN 1500 AND 9000 ORDER BY doc_id LIMIT 1").fetchone()[0]
    flat = " ".join(f"{w}p" for w in other.split())
    item = duck.execute("SELECT text FROM benchmark WHERE length(text) > 200 ORDER BY item_id LIMIT 1").fetchone()[0]
    words = flat.split()
    fresh = [f"{w}q" for w in words[:80]]
    planted = {
        900001: flat, 900002: flat, 900003: " ".join(words[:-2] + ["changed", "words."]),
        900004: " ".join(fresh[:40]) + " " + item + " " + " ".join(fresh[40:]), 900005: "### $$$ %%% " * 80, 900006: "too few words",
        900007: "Aone line here now.\nAnother line there.\nA third line too.\n" + " ".join(fresh) + ".", 900008: "Aone line here now.\nAnother line there.\nA third line too.\n" + " ".join(f"{w}z" for w in fresh) + ".",
        900009: " ".join(f"{w}k" for w in fresh) + ".",
    }
    rows = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.read.parquet(f"{small}/documents.parquet").unionByName(rows).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at), planted


def test_each_stage_does_its_part(spark, corpus):
    at, planted = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema == docs.schema
            docs = corpus_pipeline.cut(out, "test")
            left.append({r["doc_id"]: r["text"] for r in docs.where("doc_id > 900000").collect()})
    quality, lines, near, clean = left
    assert {900005, 900006} == planted.keys() - quality.keys()
    assert lines[900007] == planted[900007] and lines[900008] == planted[900008].split("\n")[3]
    assert {900002, 900003} == lines.keys() - near.keys()
    assert near.keys() - clean.keys() == {900004} and {900001, 900007, 900008, 900009} <= clean.keys()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    for r in out.where("doc_id > 900000").collect():
        ids = library.encode(clean[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_the_run_is_the_stages(spark, corpus):
    at, _ = corpus
    rows = corpus_pipeline.run(spark, at).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {900001, 900007, 900008, 900009} <= {r["doc_id"] for r in rows}


def test_stages_hold_whatever_the_columns_and_rows_are(spark, corpus):
    at, planted = corpus
    fine = planted[900001]
    rows = [(1, fine, "en", "s", 5), (1, fine, "en", "s", 5), (1, planted[900009], None, None, None), (None, fine + " and a little more", "en", "s", 7), (None, None, None, None, None), (2, "", "en", "s", 0)]
    rows += [(None, planted[900007], "en", "s", 1), (None, planted[900007], "en", "s", 1), (4, planted[900004], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = "kept n_removed n_lines contaminated hits items base_failed line_marks id comp node lost_node key tid nth_of_id a.b".split()
    docs = corpus_pipeline.cut(docs.select("*", *(F.lit(False).alias(c) for c in extra[:4]), *(F.lit("x").alias(c) for c in extra[4:])), "odd")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.schema == docs.schema and stage(spark, docs.limit(0), at).count() == 0
        left[name] = sorted((str(r["doc_id"]), (r["text"] or "")[:20]) for r in out.collect())
    ids = {name: [i for i, _ in own] for name, own in left.items()}
    assert ids["quality rules"] == ["1", "1", "1", "4", "None", "None", "None"]
    # Repeated rows are one document to line dedup, and so keep their lines.
    assert len(left["line dedup"]) == 9 and len(left["benchmark decontamination"]) == 8 and "4" not in ids["benchmark decontamination"]
    # One of the repeated rows, its near copy without an id, and one of the other repeated ones go.
    assert ids["MinHash near-dedup"] == ["1", "1", "2", "4", "None", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == len(rows)
