"""Shapes of whole words."""

from corpusmill.llm.quality import shape


def test_shape_reads_the_whole_word():
    assert shape("a" * 50 + "B7!!") == "aA0!!"
    assert shape("ÜberMaß-12²漢字..") == "AaAa-0a.."
    assert shape("") == ""
