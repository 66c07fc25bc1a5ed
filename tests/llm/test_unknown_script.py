"""The pipeline's language stage drops null and letterless texts alone."""

import corpus_pipeline

ROWS = [(1, "the cat sat on the mat"), (2, "der Hund lief"), (3, "Это русский текст"), (4, "这是一段中文"), (5, "Αυτό είναι"), (6, "12 34 !"), (7, None), (8, ""), (9, "x")]


def test_unknown_scripts_stay(spark, sf):
    for known in ({1: "en", 2: "de"}, {}):
        docs = spark.createDataFrame([(d, t, known.get(d)) for d, t in ROWS], "doc_id long, text string, lang string")
        assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()} == {1, 2, 3, 4, 5, 9}
