"""The classifier's sample takes rows of every language."""

from fernweave.llm import langid


def test_every_language_is_learned(spark):
    rows = [(100 * k + j, f"{chr(97 + k) * 3} {chr(98 + k) * 4} word{j}", f"l{k:02}") for k in range(12) for j in range(100)]
    rows += [(5000, "rare words", "rare"), (None, "no id", "none"), (5001, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.train(docs, held_out=9, rows_per_language=30, most_rows=60)
    assert sorted(model.classes) == sorted({f"l{k:02}" for k in range(12)} | {"rare"})


def test_equal_rows_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "collect_features", lambda rows, features, label: seen.extend(rows.collect()) or [])
    rows = [(1, "same text", "a")] * 50 + [(k, f"text {k}", "b") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langid.train(docs, held_out=9, rows_per_language=40)
    assert sorted(r.lang for r in seen) == ["a"] + ["b"] * 40


FOREIGN = [
    "Это обычный русский текст о погоде и о жизни в большом городе, где люди спешат на работу",
    "Αυτό είναι ένα απλό κείμενο στα ελληνικά για τον καιρό και τη ζωή",
    "これは日本語の文章です。天気と生活について書いています。",
    "Źródło wiedzy leży w książkach, które czytamy wieczorami przy świetle lampy",
    "Tämä on tavallinen suomenkielinen teksti säästä ja elämästä suuressa kaupungissa",
    "qxzv kwbc dfgh jzxq vvkw zzqj xkcd wqxz bcdf ghjk zxcv qwkj",
]


def test_rejects_foreign_text(spark):
    """Other languages and noise go, held-out documents of the learned languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    others = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(FOREIGN)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(others, model).collect())
    known = langid.identify(docs.filter(langid.fold(docs["doc_id"], 4) == 2).filter("text rlike '[a-z]{3}'"), model)
    assert known.filter("rejected").count() <= 0.005 * known.count()
