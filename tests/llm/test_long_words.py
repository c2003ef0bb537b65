from tests.llm.test_text import toxic_texts

from loomtext.llm import toxicity


def test_characters_after_the_64th_count():
    texts, y = toxic_texts(90)
    score = toxicity.Scorer(toxicity.train(texts, y, rounds=2)).score([tail.rjust(80, "x") for tail in ("", "vile", "horrid")])
    assert len(set(score.tolist())) == 3


def test_parts_of_words():
    word = "abcdefgh" * 20
    assert "".join(toxicity.words_of(f"a ({word}) b")) == f"a{word}b" and max(map(len, toxicity.words_of(word))) == 64
    assert toxicity.words_of("-" * 100) == [""] and toxicity.words_of("One (two).") == ["one", "(two)."]
