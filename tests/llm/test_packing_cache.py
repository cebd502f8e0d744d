"""The segment cache of packing gives right ids when a slice has more segments than it keeps."""

import numpy as np
import pyarrow as pa

from webloom.llm import packing
from webloom.llm.common import flat
from webloom.llm.queries import vocabulary


def test_more_segments_than_the_cache_keeps(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    encoder = packing.Encoder(vocabulary())
    for texts in (["one two three"], [" ".join(f"one two word{k}" for k in range(200)), "three one"], ["two three"]):
        ids, at = encoder.encode(*flat(pa.array(texts)))
        for k, text in enumerate(texts):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.array_equal(ids[at[k] : at[k + 1]], want)
