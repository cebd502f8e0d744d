"""Texts whose difference vanishes in a polynomial modulo 2**64, whatever its base, are not equal here."""

import hashlib
import re

import numpy as np
import pytest

from webloom.llm import common, jaccard_join, quality_rules, substring_dedup, suffix_dedup


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_spans_of_thue_morse_words_differ(n):
    text = (thue_morse(n, "ab") + thue_morse(n, "ba") + thue_morse(n, "ab")).encode()
    sums = common.prefix(common.byte_values(np.frombuffer(text, np.uint8)))
    at = np.array([0, n, 2 * n])
    a, b, c = common.spans_hash(sums, at, at + n).tolist()
    assert a != b and a == c
    # a span's hash does not depend on its place, whatever its length
    for length in (1, 31, 32, 33, 64, 65, 1000):
        one, two = common.spans_hash(sums, np.array([3, 2 * n + 3]), np.array([3, 2 * n + 3]) + length).tolist()
        assert one == two


def test_operators_tell_thue_morse_texts_apart(spark):
    n = 2048
    a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
    words = " ".join(a), " ".join(b)
    docs = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, words[0]), (5, words[1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    stats = {r.doc_id: r.stats for r in quality_rules.with_statistics(frame).collect()}
    assert stats[3]["n_dup_lines"] == 0 and stats[3]["n_distinct"] == 2
    classes = {r.id: r.component_id for r in jaccard_join.classes(frame).collect()}
    assert classes[1] == 1 and classes[2] == 2
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for r in suffix_dedup.remove(frame).collect():
        t, gone = dict(docs)[r.id], bytearray(len(dict(docs)[r.id]))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < r.id:
                gone[i : i + 50] = b"\1" * 50
        assert (r.n_removed, r.n_spans) == (sum(gone), len(re.findall(b"\1+", bytes(gone)))), r.id
    held = {}
    for _, t in docs:
        w = t.split()
        for i in range(len(w) - 34):
            key = tuple(w[i : i + 35])
            held[key] = held.get(key, 0) + 1
    for r in substring_dedup.remove(frame).collect():
        w, gone = dict(docs)[r.id].split(), set()
        for i in range(len(w) - 34):
            if held[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest(), r.id


def test_encoder_tells_thue_morse_segments_apart():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    from webloom.llm import packing

    texts = [thue_morse(4096, "ab"), thue_morse(4096, "ba")]
    data, at = common.flat(__import__("pyarrow").array(texts))
    ids, begin = packing.Encoder(path).encode(data, at)
    plain = Tokenizer.from_file(path)
    assert [ids[begin[k] : begin[k + 1]].tolist() for k in range(2)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
