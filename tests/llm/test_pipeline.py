"""The pipeline, stage by stage, on its own input."""

import corpus_pipeline
from gridcast.llm import decontaminate, language_id
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        seen[name] = ({r["doc_id"]: r for r in before}, {r["doc_id"]: r for r in after})
        assert docs.columns == columns or i == 4
        assert len({r["doc_id"] for r in after}) == len(after) > 0
    b, a = seen["language ID"]
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(a) == {d for d, r in b.items() if not model.classify(r["text"])[2]}
    b, a = seen["line dedup"]
    assert set(a) == set(b) and all(len(r["text"]) == r["n_chars"] for r in a.values())
    b, a = seen["SimHash near-dedup"]
    classes = brute_components([(d, brute_fingerprint(r["text"])) for d, r in b.items()])
    assert set(a) == {c for _, _, c in classes}
    b, a = seen["benchmark decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    phrases = [decontaminate.split_words((r["text"] or "").encode()) for r in bench]
    windows = {tuple(p[i:i + 10]) for p in phrases for i in range(max(1, len(p) - 9)) if p}

    def leaks(text):
        ws = decontaminate.split_words(text.encode())
        return any(tuple(ws[i:i + n]) in windows for n in {len(w) for w in windows} for i in range(len(ws) - n + 1))

    assert set(a) == {d for d, r in b.items() if not leaks(r["text"])}
    b, a = seen["source mix"]
    assert set(a) <= set(b) and all(r["taken"] in (r["size"], 2 * r["size"]) for r in a.values())


def test_edge_documents(spark, tmp_path):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "the and of that it was in to is", None, None, 1), (3, "x " * 20000, "en", "s", 5),
            (3, "x " * 20000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "text", "taken"} <= set(out.columns)
