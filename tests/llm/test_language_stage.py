"""The pipeline's language stage on tables with few labels or none."""

from docloom.llm import language

SCHEMA = "doc_id long, text string, lang string"


def test_unlabelled_texts_stay(spark):
    rows = [(1, "the river and the stone", None), (2, "12 !!", None), (3, None, None), (4, "el río y la piedra", None)]
    got = language.keep_known(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [rows[0], rows[3]]


def test_null_languages_are_filled(spark):
    text = {"en": "the river and the stone walk with them this evening", "es": "el río y la piedra caminan con ellos esta tarde señor"}
    rows = [(i, text[k], k) for i in range(40) for k in text] + [(100, text["en"][4:], None), (101, text["es"][3:], None), (102, "7 8", None)]
    got = {r.doc_id: r.lang for r in language.keep_known(spark.createDataFrame(rows, SCHEMA)).filter("doc_id >= 100").collect()}
    assert got == {100: "en", 101: "es"}
