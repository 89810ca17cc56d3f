"""The cleaning job as a query: whole texts and every column go through it."""

from brevia.plans import queries


def test_clean_csv_cleans_every_text_whole(spark, tmp_path):
    texts = {i: f'Says "{i}", @you\nat https://a.b/{i} #Tag, {"long " * i}'
             for i in range(1, 41)}
    spark.createDataFrame([(i, t, "en", len(t)) for i, t in texts.items()] + [(41, None, None, 0)],
                          "doc_id long, text string, lang string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 31)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in queries.q_clean_csv(spark, str(tmp_path)).collect()}
    assert {i: r.body for i, r in rows.items()} == {**texts, 41: None}
    assert {i: r.quality for i, r in rows.items()} == {
        i: i % 2 if i <= 30 else None for i in range(1, 42)}
    assert rows[41].body_cleaned == ""
    assert all(r.body_cleaned.startswith(f'says "{i}", @') and
               r.body_cleaned.endswith(("long " * i).strip()) for i, r in rows.items() if i < 41)
    assert all(rows[i].some_text in (None, "", texts[i]) for i in texts)
