"""A text without a letter has no language, whatever marks it holds."""

from raregrain.llm import language


def test_marks_are_no_letters():
    texts = ["❤️", "1́ 2́", "", None, "é", "é", "क्या"]
    assert language.ngram_hashes(texts)[2].tolist() == [False, False, False, False, True, True, True]
    model = language.LanguageFilter.build([], ["en"])
    assert model.predict(texts)[0] == ["und"] * 4 + ["en"] * 3
