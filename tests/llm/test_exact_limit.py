import numpy as np
import pytest

from loomtext.llm import neardup


@pytest.mark.parametrize("total", [63, 135 * 2, *range(9, 4000, 9)])
def test_exactly_the_least_similarity_is_linked(total):
    common = total * 4 // 9
    a, b = np.arange(common, dtype=np.uint64), np.arange(total - common, dtype=np.uint64)
    assert neardup.similarity(a, b) == neardup.LEAST
    assert neardup.similarity(a[:-1], b) == 0


def test_two_texts_of_135_shingles_with_120_in_common():
    a = np.arange(135, dtype=np.uint64)
    b = np.concatenate([a[:120], np.arange(1000, 1015, dtype=np.uint64)])
    assert neardup.similarity(a, b) == neardup.LEAST
