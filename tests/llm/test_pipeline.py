import corpus_pipeline
from brevia.llm import decontamination, language

from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF), name)
        before, after = docs.collect(), out.collect()
        kept = {r["doc_id"] for r in after}
        if name != "shard":
            assert out.columns == docs.columns
            assert set(after) <= set(before)
        if name == "language_id":
            letters = {r["doc_id"] for r in before if len(language.grams(r["text"])[0])}
            assert kept <= letters and len(kept) >= 0.97 * len(letters)
        if name == "near_duplicates":
            truth = brute([(r["doc_id"], r["text"]) for r in before], 5, 4, 5)
            assert kept == {k for k, v in truth.items() if v[0] == k} and len(after) == len(kept)
        if name == "decontaminate":
            items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
                     .select("item_id", "text").collect()]
            find = decontamination.Matcher(items)
            assert kept == {r["doc_id"] for r in before if not find(r["text"])}
        if name == "mix":
            assert len(kept) >= 0.6 * len(before)
        docs = out
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_odd_documents(spark, make_docs, odd_rows):
    rows = [*odd_rows, (1, "the same words " * 9, "en"), (1, "the same words " * 9, "en"),
            (2, "die katze und der hund sind hier", "de")]
    docs = make_docs(rows, True)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= 2 * docs.count()
        assert stage(spark, docs.filter("false"), SF).count() == 0
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert one.filter("doc_id = 1").count() == 1 and one.filter("doc_id IS NULL").count() == 1
    assert corpus_pipeline.shard(spark, docs, SF).count() == len(rows)
