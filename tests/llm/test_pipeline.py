"""The pipeline against plain versions of its stages, and extra columns named like an operator's own."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from headroom.llm import bytebpe, catalog, chat, decontaminate, fuzzylines, neardup, quality, secret_scan, toxicity
from tests.llm.samples import AWKWARD, SF, repeated_words, sha, words
from tests.llm.test_dedup_operators import grams, plain_classes
from tests.llm.test_text_operators import plain_words

#: Names that the operators use or add, in both cases.
CLASHES = ["kept", "N_WORDS", "features", "stats", "base_failed", "removed", "_removed", "gone", "doc", "mark", "T1", "t2", "class_id", "hit_spans", "Hit_Items", "in_0", "line"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
LAST = 10**18


def row(key, text, k):
    return (key, text, "en", f"s{k % 3}", None if text is None else len(text), *(f"{c} {k}" for c in CLASHES))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: real documents, near copies, shared lines, benchmark passages, awkward rows."""
    random.seed(23)
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = [t for _, t in given if t and 1000 < len(t) < 4000]
    made = []
    for i, text in enumerate(long[:20]):
        own = text.split(" ")
        own[len(own) // 2] = f"changed{i}"
        made.append((1000 + i, " ".join(own)))
    made += [(2000 + i, f"{text}\nA line that many share, number {i % 4}, with one sign other") for i, text in enumerate(long[20:40])]
    made += [(3000 + i, f"{long[40 + i]} {item} {long[50 + i][:300]}") for i, (_, item) in enumerate(items[:8])]
    made += [(4000 + i, f"{items[10 + i][1]} short end") for i in range(3)]
    made += [(5000 + i, t) for i, t in enumerate(AWKWARD)]
    made += [(None, "Nobody knows the number of this text. " + " ".join(f"word{k}" for k in range(40)))]
    pairs = [*given, *made, made[0], made[25]]
    rows = [row(key, text, k) for k, (key, text) in enumerate(pairs)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def plain_quality(text, rules):
    own, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    n, chars, repeated = len(own), sum(map(len, own)), repeated_words(text)
    share = max(n, 1)
    seen = {
        "n_words": n,
        "mean_word_chars": chars / share,
        "symbol_share": len(re.findall(r"[#*$%&|<>]", text)) / share,
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(text.split("\n"))),
        "repeat_share": repeated / share,
        "upper_share": len(re.findall("[A-Z]", text)) / max(1, chars),
        "mark_share": len(re.findall("[!?]", text)) / share,
    }
    if n < 20 or 100 * repeated > 30 * n:
        return False
    return not any(all((seen[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)


def plain_lines(pairs, threshold=0.8):
    """Texts without the lines that repeat, exactly or nearly; None for those that lose all their words."""
    places = {}
    for key, text in pairs:
        for at, line in enumerate((text or "").split("\n")):
            if words(line):
                places[line] = min(places.get(line, (key, at)), (key, at))
    lines = sorted(places, key=lambda x: len(grams(x)))
    sets, root = [grams(x) for x in lines], list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i in range(j - 1, -1, -1):
            if len(sets[i]) < threshold * len(b):
                break
            both = len(sets[i] & b)
            if both and both >= threshold * (len(sets[i]) + len(b) - both):
                root[find(j)] = find(i)
    first = {}
    for k, line in enumerate(lines):
        first[find(k)] = min(first.get(find(k), places[line]), places[line])
    kept = {line: first[find(k)] for k, line in enumerate(lines)}
    out = []
    for key, text in pairs:
        split = (text or "").split("\n")
        left = [x for at, x in enumerate(split) if x not in kept or kept[x] == (key, at)]
        out.append(None if len(left) < len(split) and not words("\n".join(left)) else "\n".join(left))
    return out


def plain_decontaminated(text, windows):
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    own = [m[0] for m in found]
    hit = {k for size in {len(w) for w in windows} for i in range(len(own) - size + 1) if tuple(own[i : i + size]) in windows for k in range(i, i + size)}
    if 2 * len(hit) > len(own):
        return None
    out, end = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[end : found[k].start()])
        end = found[k].end()
    return "".join([*out, text[end:]])


def listed(df):
    """Rows without ``text`` and ``n_chars``, and the text of each, in one order."""
    rows = sorted(df.collect(), key=lambda r: (r["kept"], str(r["doc_id"]), r["text"] or ""))
    return [tuple(v for c, v in zip(df.columns, r) if c not in ("text", "n_chars")) for r in rows], [r["text"] for r in rows]


def test_pipeline_equals_plain_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    rows, texts = listed(docs)

    def after(name):
        nonlocal docs
        docs = corpus_pipeline.stage(stages[name](spark, docs, corpus), "test")
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
        assert docs.where("n_chars <> length(text)").count() == 0
        return listed(docs)

    def kept(new):
        nonlocal rows, texts
        rows = [r for r, t in zip(rows, new) if t is not None]
        texts = [t for t in new if t is not None]

    rules = quality.learn(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    kept([t if plain_quality(t, rules) else None for t in texts])
    assert after("quality_rules") == (rows, texts) and len(rows) < 240

    ids = [LAST if r[0] is None else r[0] for r in rows]
    new = plain_lines(list(zip(ids, texts)))
    assert sum(a != b for a, b in zip(new, texts)) > 10
    kept(new)
    assert after("line_dedup") == (rows, texts)

    ids = [LAST if r[0] is None else r[0] for r in rows]
    classes = plain_classes(list(zip(ids, texts)), neardup.idf_table(docs))
    kept([t if classes[k] == k else None for k, t in zip(ids, texts)])
    assert after("near_dedup") == (rows, texts)

    windows = set()
    for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect():
        own = plain_words(r["text"])
        size = min(10, len(own))
        windows |= {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
    new = [plain_decontaminated(t, windows) for t in texts]
    assert sum(a != b for a, b in zip(new, texts)) > 5
    kept(new)
    assert after("decontamination") == (rows, texts)

    with open(catalog.BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r, t in zip(rows, texts):
        tokens = bpe.encode_ordinary(t)
        expected.append((str(r[0]), len(tokens), sha(",".join(map(str, tokens))), sha(t)))
    got = stages["byte_bpe"](spark, docs, corpus).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(expected)


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


def test_added_columns_take_the_place_of_their_namesakes(spark):
    text = "token=abcdefgh and the weather is plain today"
    df = spark.createDataFrame([(1, text, "user", "own", "own", "own"), (None, None, None, "own", "own", "own")], "doc_id long, text string, role string, SCORE string, Ids string, `a.b` string")
    model = toxicity.Model(4, 0.0, np.empty(0, int), np.empty(0))
    bench = spark.createDataFrame([(1, "the weather is plain")], "item_id long, text string")
    given = {
        ("score",): toxicity.score(df, model),
        ("ids",): bytebpe.encode(df, catalog.BYTE_BPE, public_tokenizers.PATTERN),
        ("decoded",): bytebpe.decode(bytebpe.encode(df, catalog.BYTE_BPE, public_tokenizers.PATTERN).withColumn("DECODED", F.lit("own")), catalog.BYTE_BPE, public_tokenizers.PATTERN),
        ("secrets",): secret_scan.find_secrets(df.withColumn("Secrets", F.lit("own"))),
        ("segment", "loss_start", "loss_stop", "escaped"): chat.format_turns(df.withColumns({"Segment": F.lit("own"), "escaped": F.lit("own")})),
        (*quality.BASE, "base_failed", "kept"): quality.judge(df.withColumns({"N_Words": F.lit("own"), "kept": F.lit("own")}), []),
        ("n_words", "hit_spans", "hit_items"): decontaminate.find_hits(df.withColumns({"Hit_Items": F.lit("own"), "n_words": F.lit("own")}), bench),
        ("cut",): fuzzylines.dedup_lines(df.withColumns({"CUT": F.lit("own"), "gone": F.lit("own")}), removed="cut"),
    }
    for added, got in given.items():
        assert got.columns[-len(added) :] == list(added)
        assert len({c.lower() for c in got.columns}) == len(got.columns) and "a.b" in got.columns
        found = {r["doc_id"]: r.asDict() for r in got.collect()}
        assert found[1]["text"] == text and found[1]["a.b"] == "own" and found[None]["text"] is None
        assert all(found[1][a] != "own" for a in added)
    whole = decontaminate.remove_hits(df.withColumn("hit_items", F.lit("own")), bench, coverage=1.0)
    assert {(r["doc_id"], r["hit_items"], r["SCORE"]) for r in whole.collect()} == {(1, "own", "own"), (None, "own", "own")}
    assert neardup.keep_one(df.withColumn("T1", F.lit("own"))).columns == [*df.columns, "T1"]
    with pytest.raises(ValueError, match="no column"):
        toxicity.score(df, model, text="missing")


def test_very_long_texts_are_whole(spark):
    """Texts of several MB: one word, one line, many lines."""
    long = ["x" * 3_000_000, "word " * 600_000, "\n".join(f"line number {k * 7919} of this text" for k in range(60_000))]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(df, []).drop("text").collect()}
    assert [got[k]["n_words"] for k in range(3)] == [len(words(t)) for t in long]
    bench = spark.createDataFrame([(1, "line number 0 of this text line number 7919 of")], "item_id long, text string")
    hits = {r["doc_id"]: r for r in decontaminate.find_hits(df, bench).drop("text").collect()}
    assert [hits[k]["hit_items"] for k in range(3)] == [[], [], ["1"]]
    tokens = {r["doc_id"]: r for r in bytebpe.round_trip(df.where("doc_id > 0"), catalog.BYTE_BPE, public_tokenizers.PATTERN).collect()}
    assert all(tokens[k]["decoded_sha256"] == sha(long[k]) for k in (1, 2))
    report = {r["doc_id"]: r for r in secret_scan.secret_report(df.withColumn("text", F.concat("text", F.lit(" token=abcdefgh")))).collect()}
    assert [report[k]["n_assign"] for k in range(3)] == [1, 1, 1]


def test_line_stage_keeps_lines_of_one_frequent_band_key_once(spark, monkeypatch, tmp_path):
    """Near copies whose only common key is one that many lines have are cut in the pipeline's stage as well."""
    random.seed(21)
    lines = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=90)) for _ in range(40)]
    lines += [line[:-5] + "#####" for line in lines[:6]]
    monkeypatch.setattr(fuzzylines, "TIERS", ((1, None, 1, ()),))
    docs = spark.createDataFrame([(k, line, len(line)) for k, line in enumerate(lines)], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40))
