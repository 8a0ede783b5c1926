"""The pipeline against its stages done by brute force on what the one before kept."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from morphloom.llm import quality_model as Q
from morphloom.llm import quality_rules as R

from .test_tokens_packing_dups import FILES, brute_classes, check_packed, library, near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(40, 200))]
        good = i % 5 != 0
        text = " ".join(w if good else w + "&&&" for w in words)
        if i % 7 == 3 and rows:
            text = near(rows[rng.randrange(len(rows))][1] or "", rng, 0.03)
            good = "&&&" not in text
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, int(good), 0))
    rows += [(900, None, "en", None, None), (901, "", None, "src", 0), (902, rows[1][1], "en", "src", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_and_result(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "quality rules", "near-duplicate removal", "best-fit packing"]
    one = pipeline.STAGES[0][1](spark, docs, folder)
    assert one.columns == docs.columns
    model = Q.quality_model(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i for i, t in texts.items() if model.probability(model.margin(t)) >= 0.3}
    assert {r["doc_id"] for r in one.collect()} == kept
    two = pipeline.STAGES[1][1](spark, one, folder)
    rules = R.rules_model(docs, labels)

    def passes(t):
        n, _, _, _, again = R.text_counts(t)
        return n >= 50 and 100 * again <= 50 * n and rules.probability(rules.margin(t)) >= 0.3

    kept = {i for i in kept if passes(texts[i])}
    assert {r["doc_id"] for r in two.collect()} == kept
    classes = brute_classes([(i, texts[i]) for i in sorted(kept)])
    first = {i for i, (_, c) in classes.items() if i == c}
    assert len(first) < len(kept)
    three = pipeline.STAGES[2][1](spark, two, folder)
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == first
    t = library(FILES[0])
    check_packed(pipeline.run(spark, folder).collect(), {i: [*t.encode(texts[i], add_special_tokens=False).ids, 0] for i in first})
