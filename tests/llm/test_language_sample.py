"""The sample of language identification with a hot text and a rare language."""

from collections import Counter

from lumenarc.llm import language_id


def test_each_language_has_its_own_part_of_different_texts(spark):
    hot = [("the same text in every third row", "en")] * 4000
    rows = hot + [(f"english text number {i}", "en") for i in range(8000)] + [(f"texte rare {i}", "fr") for i in range(5)]
    got = language_id.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert len(set(got)) == len(got)
    assert Counter(lang for _, lang in got) == {"en": 750, "fr": 5}


def test_bags_reach_the_driver_without_a_python_number_each(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(language_id, "fit", lambda *a: taken.update(zip(("bags", "parts", "langs"), a, strict=True)))
    rows = [("uno due tre", "it"), ("one two three", "en"), ("", "en"), ("x", None), (None, "en")]
    language_id.learn(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    want = {tuple(x.tolist()) for t, lang in rows if t is not None and lang for x in [language_id.bag(t.encode())[0]]}
    assert {tuple(ids.tolist()) for ids, _ in taken["bags"]} == want and sorted(taken["langs"]) == ["en", "en", "it"]
    assert not any(x.flags.owndata for pair in taken["bags"] + taken["parts"] for x in pair)  # slices of what Arrow holds
