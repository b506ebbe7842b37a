"""The pipeline's language stage on planted texts in no learned language, and without labels."""

import corpus_pipeline as C
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
PLANTED = [
    "Привет мир, это русский текст о погоде и природе",
    "Γειά σου κόσμε, ο καιρός είναι καλός σήμερα",
    "这是一个中文句子，关于天气和自然。今天很好",
    "नमस्ते दुनिया आज मौसम अच्छा है और हम घूमने गए",
    "xqzv jkwq pfzzt vbnmq wrtk zxcvq ghjkl qwrtp mnbvq zzxk",
    "a 1234 5678 9999 !!! ### 0000 1111 2222 @@@ 3333",
    "##### 77 %%% 1 2 3 4 5 6 7 8 9 ((())) x ///// 000 111",
]


def test_foreign_and_junk_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(PLANTED)], "doc_id long, text string")
    both = docs.unionByName(planted, allowMissingColumns=True)
    kept = dict(C.STAGES)["language"](spark, both, SF)
    assert kept.columns == docs.columns
    found = {r["doc_id"] for r in kept.collect()}
    assert not {i for i in found if i >= 10**6}
    assert found == {r["doc_id"] for r in docs.collect()}


def test_without_labels_texts_with_a_letter_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(10**6, "12 !!"), (10**6 + 1, None), (10**6 + 2, "")], "doc_id long, text string")
    kept = dict(C.STAGES)["language"](spark, docs.unionByName(odd, allowMissingColumns=True), SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in docs.collect())
