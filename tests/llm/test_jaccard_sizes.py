"""The filter before the Jaccard join keeps all pairs that link, whatever their sizes and the order of their shingles."""

import random

import numpy as np
import pytest

from webloom.llm import jaccard_join


@pytest.mark.parametrize("percent", [60, 67, 80, 90])
def test_linked_sets_see_enough_repeats(percent):
    n = np.arange(200)
    low = getattr(jaccard_join, "low_count", lambda n, percent: 2 * jaccard_join.slack(n, percent) + 1)(n, percent)
    slack = jaccard_join.slack(n, percent)
    for a in range(1, 61):
        for b in range(1, a + 1):
            for common in range(1, b + 1):
                if percent * (a + b - common) <= 100 * common:  # the order that is worst: what only one has comes first
                    seen = min(common, low[a] - (a - common), low[b] - (b - common))
                    assert seen > slack[a] and seen > slack[b], (a, b, common)


def test_nine_words_and_eight(spark):
    rng, rows = random.Random(3), []
    for k in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[1:] if k % 2 else words[:-1]))]
    found = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = sum(r.component_id == r.id - 1 for r in found if r.id % 2)
    assert linked == 40, f"{linked} of 40 pairs linked"
