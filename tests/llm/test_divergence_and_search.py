"""Source divergence and ranked search against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from headroom.llm import divergence, lexsearch

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, g long, h long, term string, row long, slice long"


def plain_divergence(rows, top=200):
    groups, df, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = Counter(w.translate(LOWER) for w in LETTERS.findall(text or ""))
        groups[lang or "", source or ""].update(found)
        df[lang or ""].update(found.keys())
        total[lang or ""].update(found)
    out = set()
    for (lang, source), counts in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]

        def share(found):
            size = sum(found[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (found[t] + 1) // size for t in kept}

        p, q = share(counts), share(total[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = share(groups[other_lang, other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode(), other))
        terms = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[t] and p[t] > q[t])
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def plain_search(rows, items, top=20):
    docs = [(i, r[0], Counter(w.translate(LOWER) for w in WORDS.findall(r[1] or ""))) for i, r in enumerate(rows)]
    n_docs, length = sum(1 for d in docs if d[2]), sum(sum(d[2].values()) for d in docs)
    df = Counter(t for d in docs for t in d[2])
    out = []
    for item_id, text in items:
        asked = Counter(w.translate(LOWER) for w in WORDS.findall(text or ""))
        scores = []
        for place, doc_id, terms in docs:
            score = 0
            for t, k in asked.items():
                if terms[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * sum(terms.values()) * n_docs // length
                    score += k * w * (10**9 * terms[t] // (1000 * terms[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, place, doc_id))
        out += [(item_id, rank, s[-1], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    made = random.Random(5)
    words = ["the", "of", "Über", "naïve", "x1", "42", "don't", "b-c", "日本", "É"] + [f"w{i}{chr(97 + i % 26)}" for i in range(60)]
    out = []
    for i in range(150):
        text = " ".join(made.choices(words, [60 / (k + 1) for k in range(len(words))], k=made.choice([0, 1, 5, 30, 200])))
        out.append((i, text, made.choice(["en", "en", "fr"]), made.choice(["big", "big", "big", "small", "tiny"]), 1, 2, "x", 3, 4))
    out += [(None, "the of THE", "en", "big"), (7, None, None, None), (8, "", "", "no words"), (9, "the " * 300_000 + "zebra", "en", "long"), (9, "the " * 300_000 + "zebra", "en", "long"), (10, "... ", "de", "a"), (11, "once", "de", "b")]
    return [tuple(r) + (None,) * (9 - len(r)) for r in out]


def test_divergence_equals_plain(spark, rows):
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert set(map(tuple, got.collect())) == plain_divergence(rows)
    small = divergence.audit(spark.createDataFrame(rows, SCHEMA), top=2).where("part = 'term'").groupBy("lang", "source").count()
    assert max(r["count"] for r in small.collect()) == 2


def test_divergence_of_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "POSTINGS", 3)
    monkeypatch.setattr(divergence, "CELLS", 4)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA))
    assert set(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(1, "a b", "en", "s") + (None,) * 5, (2, "c", "en", "t") + (None,) * 5], SCHEMA)
    assert {tuple(r) for r in divergence.audit(alone).collect()} == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


def test_groups_are_bounded(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "MAX_GROUPS", 3)
    with pytest.raises(ValueError, match="3 groups"):
        divergence.audit(spark.createDataFrame(rows, SCHEMA))


def test_shares_are_exact():
    made = random.Random(1)
    counts = [0, 1, 10**12] + [made.randrange(10**13) for _ in range(500)]
    sizes = [c + 1 + made.randrange(10**15) for c in counts]
    assert divergence.share(np.array(counts), np.array(sizes)).tolist() == [1 + 10**9 * (c + 1) // s for c, s in zip(counts, sizes)]


ITEMS = [(1, "The naïve x1"), (2, ""), (3, None), (4, "zebra zebra the"), (5, "unknown words"), (6, "日本 É über W3d w4e W5f w6g"), (6, "日本"), (None, "w9j of")]


@pytest.mark.parametrize("top, limits", [(20, {}), (3, {}), (20, {"LOOKUP": 0, "SALTS": 3, "BLOCK": 2, "SLICE_BITS": 2}), (2, {"SLICE_BITS": 1})])
def test_search_equals_plain(spark, rows, monkeypatch, top, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexsearch, name, value)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = lexsearch.search(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    seen = sorted(((r[0], r[1], None if r[2] == lexsearch.LAST else r[2], r[3]) for r in got.collect()), key=repr)
    assert seen == plain_search(rows, ITEMS, top)


def test_search_in_nothing(spark, rows):
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexsearch.search(docs.limit(0), items).count() == 0
    assert lexsearch.search(docs, items.limit(0)).count() == 0


def test_every_owner_gets_terms_and_pruning_happens(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(1, "zebra w59h w3d of the")], "item_id long, text string")
    one = lexsearch.search(docs, items, 5, shares=())
    many = lexsearch.search(docs, items, 5, shares=(0.02, 0.1, 0.3, 0.6))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
