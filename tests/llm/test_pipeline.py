"""The pipeline's stages, each against what its operator says of the stage's own input."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

from pyspark.sql import functions as F
from test_llm_operators import WORD, components_by_force, fold, shingles

import corpus_pipeline
from tidemark.llm import bpe, decontamination, line_dedup, near_dedup, quality_classifier


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_apply_their_operators(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    model = quality_classifier.train(inputs["quality_classifier"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality_classifier.score(inputs["quality_classifier"], model).where("score >= 0.5")
    assert ids(good) == ids(inputs["line_dedup"]) and len(ids(good)) < inputs["quality_classifier"].count()
    cleaned = line_dedup.drop_lines(inputs["line_dedup"]).select("doc_id", F.col("_td_kept").alias("text"))
    assert cleaned.exceptAll(inputs["near_dedup"].select("doc_id", "text")).count() == 0 and ids(cleaned) == ids(inputs["near_dedup"])
    assert inputs["near_dedup"].where("n_chars <> length(text)").count() == 0
    assert ids(near_dedup.near_duplicates(inputs["near_dedup"]).where("kept")) == ids(inputs["decontamination"])
    leaks = decontamination.contained_items(inputs["decontamination"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    assert ids(inputs["bpe"]) == ids(inputs["decontamination"].join(leaks, "doc_id", "left_anti"))
    assert bpe.round_trip(inputs["bpe"]).exceptAll(docs).count() == 0
    assert docs.where("decoded_sha256 IS NULL").count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.exceptAll(docs).count() == 0 and whole.count() == docs.count()


def test_awkward_rows_pass_through_all_stages(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "h", 0), (None, "some words", None, None, 3), (3, "word " * 20_000, "en", "h", 100_000), (3, "word " * 20_000, "en", "h", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= len(rows)
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        if name != "bpe":
            assert out.columns == docs.columns


def test_whole_pipeline_equals_brute_force(spark, sf_dir):
    """All five stages one after another on plain Python rows; only the fitted rules are taken from the operator."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def good(r):
        x = [r[f"_td_{s}"] for s in quality_classifier.STATS]
        return model.intercept + math.fsum(w for rule, w in zip(model.rules, model.weights) if all((x[i] > at) == over for i, over, at in rule)) >= 0

    rows = [(r["doc_id"], r["text"], r["source"]) for r in quality_classifier.statistics(docs, keep_text=True).collect() if good(r)]

    total, pages = defaultdict(int), defaultdict(int)
    for _, t, host in rows:
        total[host] += host is not None
        for line in {x for x in (t or "").split("\n") if WORD.search(x)}:
            pages[host, line] += 1
    bad = {k for k, n in pages.items() if k[0] is not None and n > line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * total[k[0]]}
    rows = [(d, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad), h) for d, t, h in rows]

    comp = components_by_force([(d, t or "", h) for d, t, h in rows])
    rows = [(d, t, h) for d, t, h in rows if comp.get(d, d) == d]

    items = [shingles(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        w = WORD.findall(fold(text))
        grams = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in range(1, 6)}
        return any(s and 100 * len(s & grams[len(next(iter(s)))]) >= 75 * len(s) for s in items)

    library, expected = Tokenizer.from_file(bpe.default_path()), []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d, t, _ in rows:
        if not leaks(t or ""):
            ids = library.encode(t or "", add_special_tokens=False).ids
            expected.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(expected) and 20 < len(expected) < docs.count()
