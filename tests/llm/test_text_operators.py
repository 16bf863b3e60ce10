"""Operators that work row by row: scores, rules, formats, tokens, secrets, benchmark passages."""

import base64
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headroom.llm import bytebpe, catalog, chat, decontaminate, quality, sampling, secret_scan, tokenfiles, toxicity
from headroom.sources.staging import fresh_path
from tests.llm.samples import AWKWARD, SF, documents, empty, repeated_words, rows, sha, words


def large(texts):
    return pa.array(texts, pa.large_string())


@pytest.fixture(scope="module")
def reference_bpe():
    with open(catalog.BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library_and_decodes_to_the_text(spark, reference_bpe):
    df, pairs = documents(spark)
    got = rows(bytebpe.round_trip(df, catalog.BYTE_BPE, public_tokenizers.PATTERN))
    for key, text in pairs:
        ids = reference_bpe.encode_ordinary(text or "")
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == sha(",".join(map(str, ids)))
        assert got[key]["decoded_sha256"] == sha(text or "")


def test_byte_bpe_lists_go_through_spark_and_back(spark):
    df, pairs = documents(spark, 20)
    coded = bytebpe.encode(df.withColumn("ids", F.lit("mine")), catalog.BYTE_BPE, public_tokenizers.PATTERN, output="coded")
    back = rows(bytebpe.decode(coded, catalog.BYTE_BPE, public_tokenizers.PATTERN, ids="coded"))
    assert all(bytes(back[k]["decoded"]).decode() == (t or "") for k, t in pairs)
    again = bytebpe.encode(coded, catalog.BYTE_BPE, public_tokenizers.PATTERN, output="ids")
    assert again.where("ids <> coded or ids is null").count() == 0 and again.count() == len(pairs)
    assert bytebpe.round_trip(empty(spark), catalog.BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_recognises_strangers():
    keys = [f"key{i}".encode() for i in range(3000)]
    table = bytebpe.PerfectHash(keys)
    found = table.lookup(pa.array([*keys, b"other", b""], pa.large_binary()))
    assert found[:3000].tolist() == list(range(3000))
    assert found[3000:].tolist() == [-1, -1]
    assert sorted(table.at.tolist()) == list(range(3000))


def test_token_files_hold_the_librarys_ids_in_order(spark):
    df, pairs = documents(spark)
    tokenizer = Tokenizer.from_file(catalog.WORD_BPE)
    folder = fresh_path(spark, "tokens")
    tokenfiles.write(df, folder, catalog.WORD_BPE, end=2)
    got, start = rows(tokenfiles.summary(spark, folder)), 0
    assert len(got) == len(pairs)
    offsets = rows(tokenfiles.offsets(spark, folder))
    for key, text in sorted(pairs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[key]["start"], got[key]["n_tokens"]) == (start, len(ids))
        assert got[key]["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert offsets[key]["start"] == start
        start += len(ids)


def test_token_files_hold_added_tokens_as_the_library_finds_them(spark):
    texts = ["a<|endoftext|>b end", "x  <|startoftext|>  y<|endoftext|>", "<|STARTOFTEXT|> é<|endoftext|>é", "<|endoftext|><|endoftext|>", "plain | < text"]
    tokenizer = Tokenizer.from_file(catalog.WORD_BPE)
    folder = fresh_path(spark, "tokens")
    tokenfiles.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, catalog.WORD_BPE, end=2)
    got = rows(tokenfiles.read(spark, folder))
    for i, text in enumerate(texts):
        assert got[i]["ids"] == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert got[0]["ids"].count(49407) == 1 and got[1]["ids"].count(49406) == 1


def test_token_files_cut_plain_words_on_blocks_as_the_library_does():
    encoder, tokenizer = tokenfiles.Encoder(catalog.WORD_BPE), Tokenizer.from_file(catalog.WORD_BPE)
    split, one_by_one = encoder.split, []
    encoder.split = lambda word: one_by_one.append(word) or split(word)
    parts = ["abc", "Él", "1", "½", "_-", "x|", "É", "²³", "ß", "ǅ"]
    plain = [f"{a}{b}{c}" for a in parts for b in parts for c in parts]
    odd = ["don't", "'S", "İz", "日本1", "a\xa0b", "\x85", "\xad", "<|endoftext|>x", "a<b", "e\u0301"]
    texts = [" ".join(plain), "", " ".join(odd), *odd, "\n", "".join(odd), *(a + b for a in odd for b in parts)]
    got = encoder.encode(pa.array(texts, pa.large_string()), 2).to_pylist()
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert one_by_one and not set(one_by_one) & {w.lower() for w in plain}


def test_token_files_are_summed_up_in_one_read_of_the_ids(spark):
    folder = fresh_path(spark, "tokens")
    tokenfiles.write(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"), folder, catalog.WORD_BPE, end=2)
    scans = [line for line in tokenfiles.summary(spark, folder)._jdf.queryExecution().toString().split("Physical Plan")[-1].splitlines() if "FileScan parquet" in line]
    assert len(scans) == 2 and sum("ids:array" in line for line in scans) == 1


def test_token_files_are_readable_by_column_and_key(spark):
    df, _ = documents(spark)
    folder = fresh_path(spark, "tokens")
    tokenfiles.write(df.withColumn("ids", F.lit(1)), folder, catalog.WORD_BPE, end=2)
    few = tokenfiles.read(spark, folder).where("doc_id = 7").select("n_tokens")
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan and "ids:array" not in plan.split("ReadSchema")[-1]
    assert few.count() == 1
    none = fresh_path(spark, "tokens")
    tokenfiles.write(empty(spark), none, catalog.WORD_BPE, end=2)
    assert tokenfiles.summary(spark, none).count() == 0


PATTERNS = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
    re.compile("gh[pousr]_[A-Za-z0-9]+"),
    re.compile("xox[abprs]-[A-Za-z0-9-]+"),
]


def plain_secrets(text):
    found = []
    for r, (pattern, rule) in enumerate(zip(PATTERNS, secret_scan.RULES, strict=True)):
        found += [(m.start(), r, m.end()) for m in pattern.finditer(text) if len(m[0] if rule.whole else m[2]) >= rule.least]
    return sorted(found)


def test_secrets_equal_regular_expressions(spark):
    df, pairs = documents(spark)
    got = rows(secret_scan.secret_report(df))
    for key, text in pairs:
        found = plain_secrets(text or "")
        listed = [f"{secret_scan.RULES[r].kind}:{a}:{b}" for a, r, b in found]
        assert got[key]["spans"] == ",".join(listed)
        assert got[key]["base_sha256"] == sha(",".join(s for s, (_, r, _) in zip(listed, found, strict=True) if r < 3))
        assert [got[key][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(r == k for _, r, _ in found) for k in range(3)]
    assert sum(r["n_assign"] for r in got.values()) > 0
    kept = secret_scan.find_secrets(df.withColumn("kind", F.lit("mine"))).where("size(secrets) > 0").first()
    assert kept["kind"] == "mine" and kept["secrets"][0]["stop"] > kept["secrets"][0]["start"]
    assert secret_scan.secret_report(empty(spark)).count() == 0


def test_secrets_equal_regular_expressions_on_random_pieces():
    import random

    random.seed(3)
    pieces = ["token", "Token", "passwd", "api_key", "=", ":", " ", '"', "'", "AKIA", "abcdef012345", "ABCD1234EFGH", "é", "\n", ",", "ghp_", "xoxb-", "-", "+"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    found = secret_scan.Scanner().spans(large(texts))
    assert [found.get(i, []) for i in range(len(texts))] == [plain_secrets(t) for t in texts]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 300])
def test_hits_equal_a_search_for_all_windows(spark, monkeypatch, shard_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    df, pairs = documents(spark)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "e f g"), (901, "one"), (902, None), (903, ""), (900, "e f g"), (904, "A b C d e f g h i j k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.find_hits(df, bench))
    windows = {}
    for name, text in items:
        own = plain_words(text)
        size = min(10, len(own))
        for i in range(len(own) - size + 1) if own else ():
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(name))
    for key, text in pairs:
        own, hit, names = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(own[i : i + size])]
        spans = got[key]["hit_spans"]
        assert (got[key]["n_words"], {k for s in spans for k in range(s["first"], s["stop"])}) == (len(own), hit)
        assert got[key]["hit_items"] == sorted(names)


def test_hits_are_cut_and_covered_documents_go(spark):
    df = spark.createDataFrame([(1, "Start here: a b c d e f g h i j, then more words to keep the text alive ok"), (2, "a b c d e f g h i j"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A B C D E F G H I J")], "item_id long, text string")
    left = rows(decontaminate.remove_hits(df, bench))
    assert left[1]["text"] == "Start here: , then more words to keep the text alive ok"
    assert 2 not in left and left[3]["text"] is None
    assert decontaminate.remove_hits(empty(spark), bench).count() == 0
    assert decontaminate.find_hits(df, bench.limit(0)).where("size(hit_spans) > 0").count() == 0


@pytest.mark.parametrize("chained", [decontaminate.CHAINED, 2])
def test_scans_and_cuts_share_a_python_worker(spark, monkeypatch, chained):
    df, _ = documents(spark)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = rows(decontaminate.remove_hits(df, bench, coverage=0.9))
    found = rows(decontaminate.find_hits(df, bench))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    monkeypatch.setattr(decontaminate, "CHAINED", chained)
    cut, hits = decontaminate.remove_hits(df, bench, coverage=0.9), decontaminate.find_hits(df, bench)
    # each step in Python of one stage has a worker for each task
    for out in (cut, hits):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert rows(cut) == whole
    assert rows(hits) == found


def test_statistics_equal_plain_counts(spark):
    df, pairs = documents(spark)
    got = rows(quality.judge(df, []))
    for key, text in pairs:
        own, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        expected = (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated_words(text))
        assert tuple(got[key][c] for c in quality.BASE) == expected
        failed = len(own) < 20 or 100 * expected[4] > 30 * len(own)
        assert (got[key]["base_failed"], got[key]["kept"]) == (failed, not failed)


def test_rules_are_learned_and_leave_good_texts_alone(spark):
    good = [(i, " ".join(f"word{i * 7 + k}" for k in range(30)), 1) for i in range(60)]
    bad = [(100 + i, " ".join(f"###{i * 7 + k}" for k in range(30)), 0) for i in range(60)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    rules = quality.learn(both.select("doc_id", "text"), both.select("doc_id", "quality"))
    kept = rows(quality.judge(both.select("doc_id", "text"), rules))
    assert rules and all(kept[k]["kept"] == (k < 100) for k in kept)
    assert quality.learn(both, both.limit(0).select("doc_id", "quality")) == []
    assert quality.judge(empty(spark), rules).count() == 0


def test_toxic_words_are_learned(spark):
    clean = [(i, f"plain words number{i} about the weather and w{i % 17}", 0) for i in range(200)]
    toxic = [(1000 + i, f"plain words number{i} you idiot and w{i % 17}", 1) for i in range(100)]
    both = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    sample = sampling.labelled_sample(both, both, "toxic", 10_000)
    model = toxicity.train(sample)
    new = spark.createDataFrame([(1, "such an idiot here"), (2, "the weather is plain"), (3, None), (4, "")], "doc_id long, text string")
    got = rows(toxicity.score(new, model))
    assert got[1]["score"] > 0.7 > 0.5 > got[2]["score"]
    assert got[3]["score"] == got[4]["score"] and 0 <= got[3]["score"] <= 1
    assert len(model.coordinates) < 2000
    halves = toxicity.train(sample, shards=2)
    assert rows(toxicity.score(new, halves))[1]["score"] > 0.5
    none = toxicity.train(sample.limit(0))
    assert rows(toxicity.score(new, none))[1]["score"] < 1e-6


def test_the_sample_of_labels_is_bounded(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "'x' as text", "1 as toxic")
    assert 300 < sampling.labelled_sample(many, many, "toxic", 500).count() < 700


def test_conversations_read_back(spark):
    said = [t for t in AWKWARD] + ["</s>[INST] ok [/INST]", "[/INST]</s><s>user[INST]", "<\\\\s>", "<", "[", "\\"]
    turns = [(c, n, r, said[(c + n) % len(said)]) for c in range(20) for n, r in enumerate(["user", "assistant", None, "</s>", "assistant"])]
    turns += [(1, 0, "user", said[1])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    out = chat.format_conversations(df).withColumn("turns", chat.parse(chat.formatted_text())).withColumn("loss_text", chat.loss_text())
    got = rows(out, "conv_id")
    for c in range(20):
        own = sorted((n, r or "", t or "") for k, n, r, t in turns if k == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, t) for _, r, t in own]
        assert got[c]["loss_text"] == "".join(t for _, r, t in own if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0
    plain = spark.createDataFrame([("no turns",), ("<s>user[INST]hi[/INST]",), ("<s>user[INST]hi[/INST]</s>x",)], "t string")
    assert [r[0] for r in plain.select(chat.parse(F.col("t"))).collect()] == [None, None, None]


def test_files_beyond_five_digits_follow_the_others(spark):
    made = [(1, 5, "part-00007-x-c000.parquet"), (2, 6, "part-99999-x-c000.parquet"), (3, 7, "part-100000-x-c000.parquet"), (4, 8, "part-100000-x-c000.parquet")]
    got = rows(tokenfiles.with_offsets(spark.createDataFrame(made, "doc_id long, n_tokens long, file string"), "doc_id"))
    assert [got[k]["start"] for k in (1, 2, 3, 4)] == [0, 5, 11, 18]
