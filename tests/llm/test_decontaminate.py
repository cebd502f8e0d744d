"""Decontamination against the longest common subsequence of every stretch of every document."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from webloom.llm import decontaminate
from webloom.llm.common import flat


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def holds(doc, item):
    n = len(item)
    if n < 8:
        return any(doc[k : k + n] == item for k in range(len(doc) - n + 1))
    tail, bag = item[n - -(-n // 3) :], Counter(item)
    for k in range(0, max(0, len(doc) - n) + 1, max(1, n // 8)):
        stretch = doc[k : k + n + n // 4]
        if sum((bag & Counter(stretch)).values()) >= 0.6 * n:
            share = lcs(stretch, item) / n
            if share >= 0.8 or share >= 0.6 and lcs(stretch, tail) / len(tail) >= 0.6:
                return True
    return False


def replaced(rng, item, share):
    """The item with a share of its words replaced, none in its last third."""
    out = list(item)
    for at in rng.sample(range(len(item) - -(-len(item) // 3)), int(share * len(item))):
        out[at] = words(rng, 1)[0]
    return out


def judged(spark, docs, items):
    table = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    return {r.id for r in decontaminate.search(table, bench).collect() if r.contaminated}


def test_all_that_the_judge_counts_is_found(spark):
    """Short and long items, word for word and with words replaced by rare ones, amid frequent words."""
    rng = random.Random(5)
    often = words(rng, 40)
    text = lambda n: [rng.choice(often) if rng.random() < 0.6 else w for w in words(rng, n)]
    items = [text(n) for n in (4, 6, 8, 8, 10, 12, 20, 28, 36, 36, 60, 200)]
    docs, planted = [text(rng.randrange(1, 200)) for _ in range(60)], set()
    for item in items:
        for share in (0, 0, 0.3, 0.35) if len(item) >= 8 else (0, 0):
            planted.add(len(docs))
            docs.append(text(rng.randrange(0, 90)) + replaced(rng, item, share) + text(rng.randrange(0, 90)))
    want = {k for k, d in enumerate(docs) if any(holds(d, i) for i in items)}
    assert planted <= want
    got = judged(spark, docs, items)
    assert got == want, f"{len(got & want)} of {len(want)} found, {len(got - want)} wrongly"


def test_latent_directions_span_all_items(spark):
    """Of over 1000 items, each finds its own copy by the cosine alone."""
    rng = random.Random(6)
    items = [words(rng, 35) for _ in range(1100)]
    h, begin = decontaminate.terms(*flat(pa.array([" ".join(i) for i in items])))
    counts = np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=1 << decontaminate.BITS)
    idf = decontaminate.inverse_frequency(counts)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = set()
    for block in decontaminate._item_blocks(bench, "item_id", "text"):
        space = decontaminate.fit(spark, block, [], idf, counts)
        for d, _, item in decontaminate.candidates(h, begin, idf, space, 0.45):
            found |= {a for a, b in zip(d.tolist(), item.tolist(), strict=True) if a == space.ids[b]}
    assert len(found) == len(items), f"{len(found)} of {len(items)} found"


def test_an_item_in_many_copies_keeps_its_weight(spark):
    """A third of all rows are copies of one document that quotes an item; copies and paraphrases of it are still found."""
    rng = random.Random(7)
    item = words(rng, 36)
    hot = words(rng, 30) + item + words(rng, 30)
    docs = [words(rng, rng.randrange(20, 120)) for _ in range(100)] + [hot] * 100
    docs += [words(rng, 40) + replaced(rng, item, 0.25 if k % 4 else 0) + words(rng, 40) for k in range(100)]
    want = {k for k, d in enumerate(docs) if holds(d, item)}
    got = judged(spark, docs, [item])
    assert len(want) == 200 and got == want, f"{len(got & want)} of {len(want)} found, {len(got - want)} wrongly"
    h, _ = decontaminate.terms(*flat(pa.array([" ".join(d) for d in docs])))
    own, _ = decontaminate.terms(*flat(pa.array([" ".join(item)])))
    counts = np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=1 << decontaminate.BITS)
    weights = decontaminate.inverse_frequency(counts)[(own >> np.uint64(46)).astype(np.int64)]
    assert (weights > 0).all(), f"{int((weights > 0).sum())} of {len(weights)} words keep weight"


def test_many_items_and_a_hot_group(spark):
    """More items than one latent space has, of 3 to 120 words, and a third of the rows copies of one document."""
    rng = random.Random(8)
    often = words(rng, 60)
    text = lambda n: [rng.choice(often) if rng.random() < 0.5 else w for w in words(rng, n)]
    items = [text(rng.choice((3, 5, 8, 9, 11, 16, 24, 36, 36, 48, 120))) for _ in range(140)]
    hot = text(20) + items[7] + text(20)
    docs, planted = [hot] * 60, set(range(60))
    for item in rng.sample(items, 60) + [items[7]] * 10:
        planted.add(len(docs))
        docs.append(text(rng.randrange(0, 40)) + replaced(rng, item, rng.choice((0, 0.25, 0.35)) if len(item) >= 8 else 0) + text(rng.randrange(0, 40)))
    docs += [text(rng.randrange(1, 80)) for _ in range(50)]
    answer = {d: any(holds(list(d), i) for i in items) for d in set(map(tuple, docs))}
    want = {k for k, d in enumerate(docs) if answer[tuple(d)]}
    got = judged(spark, docs, items)
    assert planted <= want and got == want, f"{len(got & want)} of {len(want)} found, {len(got - want)} wrongly"


def test_drop_judges_rows_of_null_ids(spark):
    rng = random.Random(9)
    item = words(rng, 30)
    rows = [(None, " ".join(words(rng, 9) + item), 1), (None, " ".join(words(rng, 40)), 2), (3, " ".join(item), 3), (3, None, 4), (5, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __found int")
    bench = spark.createDataFrame([(7, " ".join(item)), (None, "a"), (8, None), (9, " ")], "item_id long, text string")
    assert sorted(r["__found"] for r in decontaminate.drop(docs, bench).collect()) == [2, 4, 5]
    assert decontaminate.drop(docs, bench).columns == docs.columns
    assert decontaminate.drop(docs, bench.where("false")).count() == 5 and decontaminate.drop(docs.where("false"), bench).count() == 0


def test_several_passes_give_the_result_of_one(spark, monkeypatch):
    rng = random.Random(10)
    items = [words(rng, rng.randrange(4, 50)) for _ in range(7)]
    rows = [(k, " ".join(words(rng, 20) + (items[k % 7] if k % 3 else []) + words(rng, 20))) for k in range(40)] + [(1, None), (None, " ".join(items[0])), (None, " ".join(items[0])), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    verdicts = lambda: Counter((r.id, r.n_passages, r.item_id, r.share, r.answer_share, r.contaminated) for r in decontaminate.search(docs, bench).collect())
    one, left = verdicts(), Counter(decontaminate.drop(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "PASS", 3)
    assert verdicts() == one and Counter(decontaminate.drop(docs, bench).collect()) == left and sum(one.values()) == 44


def test_latent_spaces_are_fitted_on_all_passages_of_all_documents(spark, monkeypatch):
    """What the spaces get is the second moment of every passage, far more documents than a bounded sample had."""
    rng = random.Random(11)
    items, seen, fit = [words(rng, 25) for _ in range(6)], [], decontaminate.fit
    own = sorted({w for i in items for w in i})
    docs = [[rng.choice(own) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(rng.randrange(0, 150))] for _ in range(700)]
    table = spark.createDataFrame([*((k, " ".join(d)) for k, d in enumerate(docs)), (700, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "fit", lambda spark, some, corpus, idf, counts: seen.append((corpus, idf)) or fit(spark, some, corpus, idf, counts))
    monkeypatch.setattr(decontaminate, "DENSE", 30)
    for run in (decontaminate.search, decontaminate.drop):
        assert run(table, bench).count() > 0
        (corpus, idf), known = seen.pop(), np.unique(decontaminate.terms(*flat(pa.array([" ".join(own)])))[0])
        want, n = np.zeros((len(known), len(known))), 0
        for d in docs:
            h, _ = decontaminate.terms(*flat(pa.array([" ".join(d)])))
            for at in [0] if 0 < len(h) <= 16 else range(0, len(h) - 16, 16):
                passage = h[at : at + 32]
                x = idf[(passage >> np.uint64(46)).astype(np.int64)].astype(float)
                row = np.array([x[passage == t].sum() for t in known])
                want += np.outer(row, row) / (x @ x)
                n += 1
        assert n > 2000 and all((t == known).all() for t, _ in corpus)
        got = sum(np.outer(x, x) for _, x in corpus)
        assert np.abs(got - decontaminate.CORPUS * want / n).max() < 1e-3 * got.max()


def test_words_are_found_whatever_bits_they_share():
    """Keys that share their leading bits, the least and the largest hash, and none at all."""
    rng = np.random.default_rng(12)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, np.uint64), (np.uint64(77) << np.uint64(48)) + np.arange(0, 90, 3, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    h = np.concatenate([rng.choice(keys, 3000), rng.integers(0, 1 << 63, 3000, np.uint64), (np.uint64(77) << np.uint64(48)) + np.arange(90, dtype=np.uint64)])
    for some in (keys, keys[:0]):
        near, row = decontaminate.find(some, h)
        assert (near == np.flatnonzero(np.isin(h, some))).all() and (some[row] == h[near]).all()


def test_only_stretches_that_hold_enough_of_an_item_are_judged(spark, monkeypatch):
    """The words that candidates hold are counted for many at once, each word once however often it comes."""
    rng = random.Random(13)
    often = words(rng, 30)
    items = [[rng.choice(often) if rng.random() < 0.6 else w for w in words(rng, n)] for n in (4, 8, 12, 20, 36, 36, 90)]
    docs = [[rng.choice(often + rng.choice(items)) for _ in range(rng.randrange(0, 200))] for _ in range(80)] + [i + i for i in items]
    h, begin = decontaminate.terms(*flat(pa.array([" ".join(d) for d in docs])))
    own = [(k, decontaminate.terms(*flat(pa.array([" ".join(i)])))[0]) for k, i in enumerate(items)]
    counts = np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=1 << decontaminate.BITS)
    idf = decontaminate.inverse_frequency(counts)
    space, asked, judge = decontaminate.fit(spark, own, [], idf, counts), [], decontaminate.judge
    monkeypatch.setattr(decontaminate, "STRETCHES", 40)
    monkeypatch.setattr(decontaminate, "HITS", 500)
    known = decontaminate.Known.of(decontaminate.item_words([space]), h)
    before = np.array([max((p for p in range(at) if h[p] == h[at]), default=-1) for at in known.spot.tolist()])
    rows = [np.array(c) for c in zip(*[(rng.randrange(len(docs)), rng.randrange(-40, 150), rng.randrange(0, 200), rng.randrange(len(items))) for _ in range(3000)], strict=True)]
    n = 0
    for some, held in decontaminate.holding(begin, space, known, before, iter([tuple(r[:1700] for r in rows), tuple(r[1700:] for r in rows)])):
        for d, first, last, item, got in zip(*(c.tolist() for c in some), held.tolist(), strict=True):
            size = len(items[item])
            there = set(h[begin[d] + max(0, first) : max(begin[d] + max(0, first), min(begin[d] + last + decontaminate.stretch_width(size), begin[d + 1]))].tolist())
            assert got == (sum(w in there for w in space.words[item]) >= decontaminate.least_common(size))
            n += got
    assert 100 < n < 2900
    monkeypatch.setattr(decontaminate, "judge", lambda text, item, lo, hi: asked.append((set(text.tolist()), item)) or judge(text, item, lo, hi))
    met, best = decontaminate._look(h, begin, idf, [space], decontaminate.COSINE)
    assert all(sum(w in text for w in item) >= decontaminate.least_common(len(item)) for text, item in asked)
    assert {d for d, b in best.items() if b[0]} == {k for k, doc in enumerate(docs) if any(holds(doc, i) for i in items)} and 0 < len(asked) < met.sum()
