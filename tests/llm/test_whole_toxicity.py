"""Toxic words shorter than stems are terms too."""

from meridia.llm import toxicity


def test_short_words_are_terms(spark):
    rows = [(f"you zug number{i}", 1) for i in range(6)] + [(f"you good number{i}", 0) for i in range(6)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "t string, toxic int"))
    assert [(t.text, t.stem, t.edits) for t in terms] == [("zug", False, 0)]
    scorer = toxicity.Scorer(toxicity.Model(tuple(terms), (-3.0, 2.0, 1.0, 0.5, 0.0)))
    assert scorer.score("a zug here") > scorer.score("a zag here")
