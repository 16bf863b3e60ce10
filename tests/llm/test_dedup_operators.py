"""Operators that compare rows: repeated passages, lines, near-duplicates; and the pipeline."""

import collections
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from headroom.llm import catalog, fuzzylines, linking, neardup, substrings
from headroom.llm import words as W
from headroom.sources import staging
from tests.llm.samples import SF, documents, empty, rows, sha, words


def plain_repeats(pairs, size=13):
    least = {}
    for key, text in pairs:
        own = words(text)
        for i in range(len(own) - size + 1):
            run = tuple(own[i : i + size])
            least[run] = min(least.get(run, key), key)
    out = {}
    for key, text in pairs:
        own = words(text)
        gone = {k for i in range(len(own) - size + 1) if least[tuple(own[i : i + size])] < key for k in range(i, i + size)}
        out[key] = (len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone))
    return out


def test_repeats_equal_a_table_of_all_windows(spark):
    random.seed(5)
    df, pairs = documents(spark)
    vocabulary = ["a", "b", "c", "dd"]
    made = [(200_000 + i, " ".join(random.choice(vocabulary) for _ in range(random.randint(5, 60)))) for i in range(150)]
    made += [(300_000 + i, " ".join([f"u{i}", *(f"w{k}" for k in range(40)), f"v{i}"])) for i in range(30)]
    pairs += made
    df = df.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    expected = plain_repeats(pairs)
    got = rows(substrings.remove_repeats(df))
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == expected
    digest = rows(substrings.digest_repeats(df))
    assert all(digest[k]["kept_sha256"] == sha(v[2]) for k, v in expected.items())


def test_repeats_of_null_and_equal_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(None, text), (1, text), (1, text + " more"), (2, text)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == {(None, 0): 1, (1, 0): 2, (2, 20): 1}
    assert substrings.remove_repeats(empty(spark)).count() == 0


def grams(line, size=5):
    return {line[k : k + size] for k in range(len(line) - size + 1)}


def test_lines_are_kept_once_a_class(spark):
    random.seed(7)
    base = ["".join(random.choice("abcdefgh ") for _ in range(90)) for _ in range(12)]
    texts = []
    for i in range(60):
        line = list(base[i % 12])
        line[random.randrange(90)] = random.choice("xyz")
        texts.append((i, f"\n{''.join(line)}\nown line number {i} {random.random()}\nshort"))
    texts += [(100, None), (101, ""), (102, " \n \n"), (103, "short\nshort")]
    df = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    lines = []
    for i, t in texts:
        lines += [(i, p, x) for p, x in enumerate((t or "").split("\n")) if words(x)]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, (_, _, y) in enumerate(lines):
        for i in range(j):
            a, b = grams(lines[i][2]), grams(y)
            if lines[i][2] == y or (a and b and len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    kept = {(i, p) for k, (i, p, _) in enumerate(lines) if find(k) == k}
    got = rows(fuzzylines.dedup_lines(df, removed="removed"))
    for i, t in texts:
        left = [x for p, x in enumerate((t or "").split("\n")) if not words(x) or (i, p) in kept]
        assert got[i]["text"] == (None if t is None else "\n".join(left)), i
    assert got[103]["removed"] == 2 and got[100]["lang"] == "en"
    assert fuzzylines.dedup_lines(empty(spark)).count() == 0


def keys_of(lines):
    found = [set() for _ in lines]
    for line, key in zip(*fuzzylines.band_keys(pa.array(lines, pa.large_string()))):
        found[line].add(int(key))
    return found


def test_band_keys_do_not_depend_on_the_block():
    lines = ["", "abcd", "abcde", "日本語🙂é and more", "x" * 300, "one line of words " * 40, None]
    lines = [line or "" for line in lines]
    together = keys_of(lines * 50)
    for i, line in enumerate(lines):
        assert keys_of([line])[0] == together[i] == together[i + len(lines)]
        assert bool(together[i]) == (len(line) >= 5)


def test_jaccard_equals_sets():
    random.seed(3)
    lines = ["", "abc", "abcdef", "日本語🙂é and", *("".join(random.choice("abé") for _ in range(random.randint(0, 40))) for _ in range(200))]
    other = random.sample(lines, len(lines))
    got = fuzzylines.jaccard(pa.array(lines, pa.large_string()), pa.array(other, pa.large_string()))
    for x, y, sim in zip(lines, other, got):
        a, b = grams(x), grams(y)
        assert sim == (len(a & b) / len(a | b) if a | b else 0.0)


def test_line_candidates_find_nearly_all_similar_pairs():
    random.seed(11)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(400)]
    pairs = []
    while len(pairs) < 400:
        line = " ".join(random.choice(vocabulary) for _ in range(random.randint(8, 40)))
        other = list(line)
        for _ in range(random.randint(1, max(1, len(line) // 60))):
            other[random.randrange(len(other))] = "z"
        other = "".join(other)
        if len(grams(line) & grams(other)) >= 0.8 * len(grams(line) | grams(other)):
            pairs.append((line, other))
    x, y = (keys_of([p[i] for p in pairs]) for i in (0, 1))
    assert sum(bool(a & b) for a, b in zip(x, y)) >= 0.95 * len(pairs)
    # nearly all share two keys, which is what counts where keys are frequent
    assert sum(len(a & b) > 1 for a, b in zip(x, y)) >= 0.95 * len(pairs)


@pytest.mark.parametrize(
    "letters, length",
    [("0123456789,", 60), ("0123456789abcdf", 200), ("ABCDEFGHIJ_;", 100), ("ACGT", 150), ("/abcdfghij.-", 400), ("0123456789;", 20), ("абвгдежзик", 90)],
)
def test_line_candidates_need_no_words_and_no_common_start(letters, length):
    random.seed(13)
    pairs = []
    while len(pairs) < 150:
        line = "".join(random.choice(letters) for _ in range(length))
        # a date or number in front; of short lines only its first character differs
        start = "".join(random.choice("QRSTUVWXYZ") for _ in range(8 if length > 80 else 1))
        other = start + line[len(start) :]
        if len(grams(line) & grams(other)) >= 0.8 * len(grams(line) | grams(other)):
            pairs.append((line, other))
    x, y = (keys_of([p[i] for p in pairs]) for i in (0, 1))
    assert sum(bool(a & b) for a, b in zip(x, y)) >= 0.97 * len(pairs)
    # lines that have next to nothing in common do not meet
    if len(letters) > 4:
        assert sum(bool(a & b) for a, b in zip(x, x[1:])) <= 2


def test_lines_that_differ_in_their_first_characters_are_kept_once(spark):
    line = ",".join(str(k * 7919 % 1000) for k in range(60))
    df = spark.createDataFrame([(i, f"{i * 1234567:08d},{line}") for i in range(1, 6)], "doc_id long, text string")
    got = rows(fuzzylines.dedup_lines(df, removed="removed"))
    assert [got[i]["removed"] for i in range(1, 6)] == [0, 1, 1, 1, 1]


def test_similar_lines_by_cluster_chain_end_in_one_class(spark):
    # a - b - c - d: neighbours are similar, others aren't; all share one bucket
    sims = {(1, 2): 0.85, (2, 3): 0.85, (3, 4): 0.85, (1, 3): 0.7, (2, 4): 0.7, (1, 4): 0.6}
    members = spark.createDataFrame([(7, n) for n in (1, 2, 3, 4, 9)], "key long, node long")
    known = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, sim double")
    asked = []

    def compare(pairs):
        asked.append(pairs.count())
        return pairs.join(known, ["a", "b"], "left").fillna(0.1, ["sim"])

    got = {r["node"]: r["root"] for r in linking.link(members, compare, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}
    assert linking.link(members.limit(0), compare, 0.8) is None


def test_unlike_members_of_a_frequent_key_do_not_meet(spark):
    # all share key 7; three groups of 40 share key 8, 9 or 10 too, and are alike inside their group
    n = 2_000
    rows_ = [(7, k) for k in range(n)] + [(8 + k % 3, k) for k in range(120)]
    # two that share a key that few have
    rows_ += [(11, 500), (11, 501)]
    asked = []

    def compare(pairs):
        asked.append(pairs.count())
        alike = ((F.col("a") < 120) & (F.col("b") < 120) & (F.col("a") % 3 == F.col("b") % 3)) | ((F.col("a") == 500) & (F.col("b") == 501))
        return pairs.withColumn("sim", F.when(alike, 0.9).otherwise(0.1))

    got = {r["node"]: r["root"] for r in linking.link(spark.createDataFrame(rows_, "key long, node long"), compare, 0.8).collect()}
    assert got == {k: k % 3 for k in range(120)} | {500: 500, 501: 500}
    assert sum(asked) == 3 * 39 + 1


def test_members_of_frequent_keys_are_linked_as_all_their_pairs(spark):
    # points on a line under two frequent keys: similarity falls with distance, which is a metric
    random.seed(17)
    at = sorted(random.uniform(0, 6) for _ in range(150))
    members = spark.createDataFrame([(key, k) for key in (1, 2) for k in range(len(at))], "key long, node long")
    place = spark.createDataFrame(list(enumerate(at)), "node long, x double")

    def compare(pairs):
        both = pairs.join(place.toDF("a", "xa"), "a").join(place.toDF("b", "xb"), "b")
        return both.select("a", "b", F.greatest(F.lit(0.0), 1 - F.abs(F.col("xa") - F.col("xb")) * 4).alias("sim"))

    expected, root = {}, 0
    for k, x in enumerate(at):
        if k and 1 - (x - at[k - 1]) * 4 < 0.8:
            root = k
        expected[k] = root
    sizes = collections.Counter(expected.values())
    got = {r["node"]: r["root"] for r in linking.link(members, compare, 0.8).collect()}
    assert got == {k: r for k, r in expected.items() if sizes[r] > 1}

def test_members_of_one_frequent_key_meet_if_they_are_alike(spark):
    """Texts that share a single key, which many others have, are linked as all pairs are; the others don't meet."""
    random.seed(31)
    passage = [f"w{k}" for k in range(40)]
    texts, near = [], []
    for k in range(60):
        own = [f"x{k}_{j}" for j in range(60)]
        near.append((2 * k, 2 * k + 1))
        texts += [passage + own, passage + own[:-6] + [f"y{k}_{j}" for j in range(6)]]
    texts = [" ".join(t) for t in texts]
    members = spark.createDataFrame([(7, k) for k in range(len(texts))], "key long, node long")
    known = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    asked = []

    def sets(block):
        text, runs, _ = neardup.shingles(block)
        return text, runs, np.ones(len(runs))

    def rarest(nodes):
        return linking.prefixes(known.join(nodes, "node"), "text", sets, 0.8)

    def compare(pairs):
        asked.append(pairs.count())
        both = pairs.join(known.toDF("a", "ta"), "a").join(known.toDF("b", "tb"), "b")
        ta, tb = F.split("ta", " "), F.split("tb", " ")
        return both.select("a", "b", (F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))).alias("sim"))

    for crossed in (False, True):
        got = {r["node"]: r["root"] for r in linking.link(members, compare, 0.8, None, rarest, crossed).collect()}
        assert got == {n: a for a, b in near for n in (a, b)}
    assert sum(asked) < 10 * len(near)


def test_sketches_rule_out_pairs_and_never_a_link(spark):
    """Members of one key: links are all found, and near copies below the threshold are not compared."""
    random.seed(37)
    base = [f"w{k}" for k in range(120)]
    texts = [[f"u{k}x{j}" for j in range(120)] for k in range(60)]
    for k in range(60):
        # two of these have 80 of 160 words in common
        copy = base[:80] + [f"c{k}x{j}" for j in range(40)]
        texts.append(copy)
        if k < 10:
            # 108 of 132 words in common, just enough
            texts.append(copy[:108] + [f"d{k}x{j}" for j in range(12)])
    texts = [" ".join(t) for t in texts]
    members = spark.createDataFrame([(7, k) for k in range(len(texts))], "key long, node long")
    known = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    asked = []

    def sets(block):
        found = W.find_words(block, W.ALPHANUMERIC, lower=True)
        order = np.lexsort((found.hashes(), found.text_of()))
        return found.text_of()[order], found.hashes()[order], np.ones(len(order))

    def compare(pairs):
        asked.append(pairs.count())
        both = pairs.join(known.toDF("a", "ta"), "a").join(known.toDF("b", "tb"), "b")
        ta, tb = F.split("ta", " "), F.split("tb", " ")
        return both.select("a", "b", (F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))).alias("sim"))

    got = {r["node"]: r["root"] for r in linking.link(members, compare, 0.8, sketch=lambda nodes: linking.sketches(known, "text", sets)).collect()}
    assert got == {n: 60 + 2 * k for k in range(10) for n in (60 + 2 * k, 61 + 2 * k)}
    assert sum(asked) <= 40 and len(asked) <= 3


def test_wider_sketches_leave_out_pairs_just_below_the_threshold(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(500)) for _ in range(3)]

    def changed(text, n):
        at = set(rng.sample(range(len(text)), n))
        return "".join("Z" if i in at else c for i, c in enumerate(text))

    # of one base, two of 14 changes each are about 0.6 to 0.8 alike, and those of 2 changes are links
    texts = [changed(b, n) for b in base for n in [2] * 4 + [13] * 12]
    known = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    members = known.selectExpr("1L as key", "node")
    lines = pa.array(texts, pa.large_string())

    def sim(a, b):
        return float(fuzzylines.jaccard(lines.slice(a, 1), lines.slice(b, 1))[0])

    def found(**settings):
        compared = []

        def compare(pairs):
            got = [(r["a"], r["b"], sim(r["a"], r["b"])) for r in pairs.collect()]
            compared.extend(got)
            return spark.createDataFrame(got, "a long, b long, sim double")

        roots = linking.link(members, compare, 0.8, sketch=lambda nodes: linking.sketches(known, "line", fuzzylines.run_sets, 8), **settings)
        return {r["node"]: r["root"] for r in roots.collect()}, compared

    roots, compared = found()
    finer, fewer = found(finer=lambda nodes: linking.sketches(known.join(nodes, "node"), "line", fuzzylines.run_sets, fuzzylines.FINER_WORDS))
    assert finer == roots and len(fewer) < len(compared)
    links = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sim(a, b) >= 0.8}
    assert links and all(roots[a] == roots[b] for a, b in links) and set(roots) == {x for pair in links for x in pair}


def test_buckets_of_two_are_done_with_their_center(spark, monkeypatch):
    seen = []
    stage = linking.stage
    monkeypatch.setattr(linking, "stage", lambda df, name: seen.append((name, stage(df, name))) or seen[-1][1])
    texts = [f"line number {i // 2} of the whole table, told {'once' if i % 2 else 'twice'} " + "and so on " * 12 + str(i // 2) * 9 for i in range(40)]
    known = spark.createDataFrame(list(enumerate(texts)), "node long, line string")

    def compare(pairs):
        return pairs.withColumn("sim", F.lit(0.9))

    members = known.selectExpr("node div 2 as key", "node")
    roots = linking.link(members, compare, 0.8, sketch=lambda nodes: linking.sketches(known, "line", fuzzylines.run_sets, 8))
    assert {r["node"]: r["root"] for r in roots.collect()} == {i: i - i % 2 for i in range(40)}
    held = {name: table.count() for name, table in seen if name in ("members", "open", "rooted")}
    assert held == {"members": 20, "open": 0, "rooted": 0}


def test_staged_tables_leave_no_shuffle_files(spark, monkeypatch):
    before, seen, write = spark.conf.get(staging.FREE_SHUFFLES), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(spark.conf.get(staging.FREE_SHUFFLES)) or write(self, *a, **k))
    sums = staging.stage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert sums.count() == 7 and seen == ["true"] and spark.conf.get(staging.FREE_SHUFFLES) == before


def test_bounds_on_wide_sketches_are_compiled_and_sketches_kept_once_a_node(spark, monkeypatch):
    """Methods beyond 8,000 bytes stay interpreted, and a node's sketch does not stand beside each of its keys."""
    limits, columns, stage = {}, {}, staging.stage
    write = DataFrameWriter.parquet

    def noted(df, name, *args, **kwargs):
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: limits.setdefault(name, spark.conf.get(staging.METHOD_LIMIT)) and write(self, *a, **k))
        columns[name] = df.columns
        return stage(df, name, *args, **kwargs)

    monkeypatch.setattr(linking, "stage", noted)
    before = spark.conf.get(staging.METHOD_LIMIT)
    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 3
    lines = [base[: 60 + i % 7] + f" {i} " + base[i % 30 : i % 30 + 40] for i in range(60)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    fuzzylines.repeated_lines(df).collect()
    assert limits["pairs"] == limits["members"] == "8000" and spark.conf.get(staging.METHOD_LIMIT) == before
    assert not [c for c in columns["members"] if c.startswith("sketch_")]


def test_prefixes_of_similar_sets_meet(spark):
    random.seed(5)
    pairs = []
    for k in range(300):
        size = random.randrange(6, 60)
        own = random.sample(range(400), size)
        other = own[:]
        for _ in range(random.randrange(0, max(1, size // 8) + 1)):
            other[random.randrange(size)] = random.randrange(400)
        pairs += [own, other]
    known = spark.createDataFrame([(k, " ".join(f"t{v}" for v in dict.fromkeys(t))) for k, t in enumerate(pairs)], "node long, text string")

    def sets(block):
        found = W.find_words(block, W.ALPHANUMERIC, lower=True)
        own, h = found.text_of(), found.hashes()
        return own, h, (1 + (h % np.uint64(3))).astype(np.float32)

    got = {r["node"]: set(r["elements"]) for r in linking.prefixes(known.repartition(7), "text", sets, 0.8).collect()}
    whole = {r["node"]: set(r["elements"]) for r in linking.prefixes(known, "text", sets, 1e-9).collect()}
    weight = lambda s: sum(1 + (v & (2**64 - 1)) % 3 for v in s)
    alike = 0
    for a in range(0, 600):
        for b in range(a + 1, 600):
            if weight(whole[a] & whole[b]) >= 0.8 * weight(whole[a] | whole[b]):
                alike += 1
                assert got[a] & got[b]
    assert alike > 100 and sum(map(len, got.values())) < 0.4 * sum(map(len, whole.values()))


def test_lines_of_one_frequent_band_key_are_kept_once(spark, monkeypatch):
    """Two lines in a bucket of many unlike ones are still found where they share no other key."""
    random.seed(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    lines = ["".join(random.choices(letters, k=80)) for _ in range(50)]
    lines += [line[:-6] + "######" for line in lines[:10]]
    monkeypatch.setattr(fuzzylines, "TIERS", ((1, None, 1, ()),))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in fuzzylines.dedup_lines(docs).collect()}
    assert [k for k in range(60) if not out[k]] == list(range(50, 60))


def test_components_equal_union_find(spark):
    random.seed(2)
    edges = [(random.randrange(120), random.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(500, 540)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r["node"]: r["root"] for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def plain_classes(pairs, idf, threshold=0.8):
    ids, texts = [k for k, _ in pairs], [t or "" for _, t in pairs]
    text, runs, counts = neardup.shingles(pa.array(texts, pa.large_string()))
    weight = neardup.weights(runs, counts, idf)
    sets = [(runs[text == t], weight[text == t]) for t in range(len(texts))]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if texts[i] == texts[j] or neardup.weighted_jaccard(sets[i], sets[j]) >= threshold:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    least = {}
    for k, key in enumerate(ids):
        least[find(k)] = min(least.get(find(k), key), key)
    return {key: least[find(k)] for k, key in enumerate(ids)}


@pytest.fixture(scope="module")
def copies(spark):
    random.seed(4)
    _, pairs = documents(spark)
    base = [f"w{k}" for k in range(150)]
    for i in range(60):
        own = list(base)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(150)] = f"x{i}"
        pairs.append((400_000 + i, " ".join(own)))
    return spark.createDataFrame(pairs, "doc_id long, text string").repartition(4), pairs


def test_near_duplicate_classes_equal_all_pairs(spark, copies):
    df, pairs = copies
    got = {r["doc"]: r["class_id"] for r in neardup.classes(df).collect()}
    expected = plain_classes(pairs, neardup.idf_table(df))
    assert got == expected
    kept = {r["doc_id"] for r in neardup.keep_one(df.withColumn("doc", F.lit("mine"))).collect()}
    assert kept == set(expected.values())


def test_near_duplicates_of_empty_tables_and_repeated_rows(spark):
    assert neardup.classes(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc"], r["class_id"]) for r in neardup.classes(df).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (3, 2)]


def test_samples_agree_as_often_as_weights_are_similar():
    a = pa.array([" ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(60, 460))], pa.large_string())
    import numpy as np

    idf = np.ones(1 << neardup.SKETCH_BITS, dtype=np.float32)
    text, runs, counts = neardup.shingles(a)
    weight = neardup.weights(runs, counts, idf)
    _, drawn = neardup.samples(text, runs, weight, 2, 600)
    sim = neardup.weighted_jaccard((runs[text == 0], weight[text == 0]), (runs[text == 1], weight[text == 1]))
    assert abs((drawn[0] == drawn[1]).mean() - sim) < 0.07


def test_word_hashes_do_not_depend_on_place():
    found = W.find_words(pa.array(["one two", None or "", "two  one\ntwo", "é é"], pa.large_string()))
    h = found.hashes()
    assert found.counts().tolist() == [2, 0, 3, 2]
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[5] == h[6] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_equal_their_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    tidy = lambda f: f[columns].astype(str).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(expected))


def test_the_pipeline_keeps_columns_and_takes_out_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, function(spark, seen, SF)
        assert seen.columns == docs.columns
        assert seen.join(before, "doc_id", "left_anti").count() == 0
        seen = corpus_pipeline.stage(seen, "test")
        assert seen.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count() > 100
