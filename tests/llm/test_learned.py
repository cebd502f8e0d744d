"""Quality rules, URL filters and decontamination: statistics by brute force, learned parts on held-out rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import decontaminate, quality_rules, url_filter
from webloom.llm.common import flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "a", "\n\n", "line\nline\n\nline\n x", "a b c d e f g h a b c d e f g h z " * 3, "日本 語\t#*$%&|<>", " x " * 30, "one\r\ntwo\r\none\r\n", "end\n"]


def test_statistics():
    texts = ODD + [" ".join(random.Random(k).choice(["a", "bé", "#c", "d\n"]) for _ in range(60)) for k in range(30)]
    got = quality_rules.statistics(*flat(pa.array(texts, pa.string())))
    for i, text in enumerate(t or "" for t in texts):
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        held = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {k for j in range(len(words) - 7) if held[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))
        assert tuple(int(got[c][i]) for c in quality_rules.COUNTS[:5]) == want, text


def labelled(spark, n=600):
    rng, rows = random.Random(1), []
    for k in range(n):
        bad = k % 5 == 0
        words = [rng.choice("abcdefgh") * rng.randrange(1, 9) + ("***" if bad and rng.random() < 0.8 else "") for _ in range(rng.randrange(25, 60))]
        rows.append((k, " ".join(words), int(not bad), None, 3))
    docs = spark.createDataFrame([(*r[:2], *r[3:]) for r in rows], "doc_id long, text string, quality int, n_words int")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


def test_rules_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rules = quality_rules.fit(docs, labels.where("doc_id < 400"))
    assert rules and all(r.precision >= 0.9 for r in rules)
    judged = quality_rules.with_statistics(docs).where("doc_id >= 400").select("doc_id", quality_rules.rejected(rules).alias("out")).collect()
    assert np.mean([r.out == (r.doc_id % 5 == 0) for r in judged]) > 0.97


def test_all_labelled_rows_teach(spark):
    """Of 20,300 labels only those whose ids hash highest are bad."""
    rows = spark.range(20_300).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    last = rows.orderBy(F.desc("h")).limit(90).agg(F.min("h")).first()[0]
    bad = F.col("h") >= last
    docs = rows.select("doc_id", F.concat_ws(" ", F.lit("a b c"), F.col("doc_id"), F.when(bad, "***")).alias("text"))
    rules = quality_rules.fit(docs, rows.select("doc_id", (~bad).cast("int").alias("quality")))
    judged = quality_rules.with_statistics(docs).where(quality_rules.rejected(rules)).select("doc_id")
    assert {r.doc_id for r in judged.collect()} == {r.doc_id for r in rows.where(bad).collect()}


def test_rules_are_those_of_counting_every_row(spark):
    """Sums by slots, over several partitions, rules and tests, against the rows themselves."""
    rng = np.random.default_rng(3)
    x = {f: np.round(rng.gamma(2, 3, 500), 2) for f in quality_rules.FEATURES}
    bad, prune = rng.random(500) < 0.4, rng.random(500) < 0.3
    rows = spark.createDataFrame([(*(float(x[f][k]) for f in x), bool(bad[k]), bool(prune[k])) for k in range(500)], [*x, "bad", "prune"]).repartition(5)
    rules = [quality_rules.Learned((quality_rules.Test("words", True, 9.0),), 1.0)]
    tests = [quality_rules.Test("stops_per_word", False, 8.0), quality_rules.Test("digit_share", True, 2.0)]
    seen, left = quality_rules.tally(rows, rules, tests), x["words"] < 9.0
    first = x["stops_per_word"] <= 8.0
    both = first & (x["digit_share"] >= 2.0)
    assert seen.judged.tolist() == [[int((left & prune & h & bad).sum()), int((left & prune & h).sum())] for h in (np.ones(500, bool), first, both)]
    own = left & ~prune & both
    assert (seen.bad, seen.good) == ((own & bad).sum(), (own & ~bad).sum())
    for f, slots in seen.slots.items():
        spread = [(own & (x[f] >= lo) & (x[f] <= hi)) for lo, hi in slots[:, 2:]]
        assert [[(s & bad).sum(), s.sum()] for s in spread] == slots[:, :2].tolist() and sum(s.sum() for s in spread) == own.sum()


def test_no_labels_and_odd_rows(spark):
    docs, labels = labelled(spark, 40)
    assert quality_rules.fit(docs, labels.where("false")) == [] == quality_rules.fit(docs, labels.withColumn("quality", F.lit(None).cast("int")))
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    out = quality_rules.with_statistics(odd).select("*", quality_rules.base_failed().alias("f"), quality_rules.rejected([]).alias("r")).collect()
    assert len(out) == len(ODD) and not any(r.r for r in out) and [r.f for r in out] == [True, True, True, True, True, True, True, True, True, True]


RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/")]


def test_url_rules_and_list(spark):
    cases = {"http://A.Net/x": ("net/", "block"), "https://www.example.net/en/1": ("example.net/en/", "allow"), "https://example.net/en": ("net/", "block"), "https://x.example.com/de/?q": ("example.com/de/", "block"), "https://badexample.com/de/": (None, "allow"), "https://www.L.org/a/?utm_source=x&b=1&a=2#f": (None, "block"), "https://l.org/a?a=2&b=1": (None, "block"), "https://l.org/a": (None, "allow"), "http://net": (None, "allow"), "no scheme": (None, "allow"), "x://": (None, "allow")}
    pages = spark.createDataFrame([(k, u, 0, True) for k, u in enumerate([*cases, None, *cases])], "page_id long, url string, block int, listed boolean")
    listed = spark.createDataFrame([("l.org/a?a=2&b=1",), (None,), ("l.org/a?a=2&b=1",)], "key string")
    got = url_filter.judge(pages, listed, RULES).collect()
    want = [*cases.values(), (None, "allow"), *cases.values()]
    assert {r.id: (r.rule, r.verdict) for r in got} == dict(enumerate(want)) and len(got) == len(want)
    assert url_filter.judge(pages.where("false"), listed, RULES).count() == 0
    assert not any(r.listed for r in url_filter.judge(pages, listed.where("false"), RULES).collect())


@pytest.mark.parametrize("blocks", [1, 4, 1 << 15])
def test_bloom_has_no_false_answers(spark, blocks):
    keys = spark.range(0, 3000).select(F.concat(F.lit("k"), (F.col("id") * 3).cast("string")).alias("key"))
    probes = spark.range(0, 3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    got = url_filter.listed_keys(probes, keys, max_blocks=blocks).collect()
    assert len(got) == 3000 and all(r.listed == (int(r.key[1:]) % 3 == 0) for r in got)


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_decontamination(spark):
    rng = random.Random(2)
    common = words(rng, 15)
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else w for w in words(rng, n)]
    items = [text(rng.randrange(12, 50)) for _ in range(12)] + [words(rng, 4)]
    docs, leaks = [(k, " ".join(text(rng.randrange(1, 300)))) for k in range(120)], {}
    for k, item in enumerate(items):
        held = list(item)
        if k % 3 == 1 and len(item) >= 8:  # a paraphrase: some words replaced
            for at in rng.sample(range(2, len(held) - len(held) // 3), max(1, len(held) // 8)):
                held[at] = words(rng, 1)[0]
        docs.append((1000 + k, " ".join([*text(rng.randrange(0, 80)), *(w.upper() + rng.choice(["", ",", "."]) for w in held), *text(rng.randrange(0, 80))])))
        leaks[1000 + k] = k
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, " ".join(items[0])), (2003, " ".join(items[2][: len(items[2]) // 3])), (1000, docs[120][1])]
    table = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, share double")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(99, None), (98, " ")], "item_id long, text string")
    got = decontaminate.search(table, bench).collect()
    assert len(got) == len(docs)
    assert {r.id: r.item_id for r in got if r.contaminated and r.id is not None} == leaks
    assert [r.item_id for r in got if r.id is None] == [0]
    kept = decontaminate.drop(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= {2000, 2001, 2002, 2003}
    assert decontaminate.search(table.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.search(table, bench.where("false")).collect())


def test_candidates_reach_recall_of_brute_force(spark):
    """The latent cosine finds at least nine tenths of the passages whose exact cosine clears the threshold by a tenth."""
    rng = random.Random(4)
    items = [words(rng, 30) for _ in range(40)]
    docs = [words(rng, 40) + rng.choice(items)[rng.randrange(0, 10) : rng.randrange(18, 30)] + words(rng, 40) for _ in range(200)]
    h, begin = decontaminate.terms(*flat(pa.array([" ".join(d) for d in docs])))
    counts = np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=1 << decontaminate.BITS)
    idf = decontaminate.inverse_frequency(counts)
    asked = [(k, decontaminate.terms(*flat(pa.array([" ".join(i)])))[0]) for k, i in enumerate(items)]
    space = decontaminate.fit(spark, asked, [], idf, counts)
    found = set()
    for d, at, item in decontaminate.candidates(h, begin, idf, space, decontaminate.COSINE):
        found |= set(zip(d.tolist(), at.tolist(), item.tolist(), strict=True))
    weight = lambda x: idf[(np.array(x, np.uint64) >> np.uint64(46)).astype(np.int64)]
    true = set()
    for d in range(len(docs)):
        own = h[begin[d] : begin[d + 1]]
        for at in range(0, max(1, len(own) - 16), 16):
            p = own[at : at + 32]
            for k, q in asked:
                dot = sum(float(weight([w])[0]) ** 2 for w in p.tolist() if w in set(q.tolist()))
                if dot / np.sqrt((weight(p) ** 2).sum() * (weight(q) ** 2).sum()) >= decontaminate.COSINE + 0.1:
                    true.add((d, at, k))
    assert len(true) > 100 and len(true & found) >= 0.9 * len(true)
