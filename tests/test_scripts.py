from litweave.plans import queries


def test_texts_of_other_scripts_are_no_duplicates(spark, tmp_path):
    texts = ["虚拟现实 训练", "虚拟现实，训练。", "增强现实", "Виртуальная реальность", "ВИРТУАЛЬНАЯ реальность!", "Größe", "Gr e", "हिन्दी", "हन्द", "?!", "...", "?!", "", "", None, None, "A text", "a TEXT."]
    rows = [(i, "s", 0, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["keeper"] for r in queries.QUERIES["text_dup_disposition"](spark, str(tmp_path)).collect()}
    assert got == {i: i for i in range(len(texts))} | {1: 0, 4: 3, 11: 9, 13: 12, 17: 16}
