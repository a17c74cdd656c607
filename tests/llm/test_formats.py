import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from paramo.llm import bpe, mixing, preference
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaa" * 50, " \t\n  x y z\x1c\x1d\x85 ﻿", "don't we'll I'M", "日本語。😀👍🏽",
             "x" * 5000, "\x00\x01", "ⅷ²½ ٣ _foo", "tail   ", "\n\n\n", " lead", "word " * 100_000]
    for _ in range(150):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x3000), rng.randrange(0xe000, 0x20000)])) for _ in range(120)))
    return texts


def test_encoding_and_decoding_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = odd_texts()
    rows = [(i, t, [9]) for i, t in enumerate(texts)] + [(None, None, [9]), (3, texts[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    ids = bpe.encode(df, PATH)
    assert ids.columns == ["doc_id", "ids"]
    got = [r for r in ids.collect()]
    assert len(got) == len(rows) and all(r["ids"] == ([] if r["doc_id"] is None else library.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in got)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids, PATH).collect()}
    assert back[None] == "" and all(back[i] == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts))
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([(1, [15496, None, 10 ** 6, -1, 995]), (2, None), (3, []), (4, [220, 161])], "k int, ids array<int>")
    got = {r["k"]: r["text"] for r in bpe.decode(df, PATH).collect()}
    assert got[1] == "Hello world" and got[2] is None and got[3] == "" and "�" in got[4]


def test_query_digests(spark):
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op6_bpe_encoding"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_merges_by_rank_against_one_piece_at_a_time():
    v = bpe.Vocabulary(PATH)
    rank = {(a, b): r for r, (a, b) in enumerate(zip(v.left.tolist(), v.right.tolist()))}
    pieces = [bytes(p) for p in (b"aaaaaaa", b"banana", " thereea".encode(), "é€".encode(), b"x", b"abababab")]
    for piece, got in zip(pieces, v.merge(pieces)):
        ids = v.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        while (found := [(rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]):
            r, k = min(found)
            ids[k:k + 2] = [int(v.merged[r])]
        assert np.frombuffer(got, "<i4").tolist() == ids


# --- mixing --------------------------------------------------------------------------


def own_mix(rows, lift, limit, budget=None, seed=42):
    tokens = {}
    for i, s, t in rows:
        tokens[s] = tokens.get(s, 0) + t
    filled = {s: t for s, t in tokens.items() if t}
    total = sum(filled.values())
    budget = total if budget is None else budget
    p = {s: t / total for s, t in filled.items()}

    def weights(a):
        z = sum(x ** a for x in p.values())
        return {s: x ** a / z for s, x in p.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    aim = entropy(1) + lift * (math.log(len(p)) - entropy(1))
    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if entropy((low + high) / 2) >= aim - 1e-12 else (low, (low + high) / 2)
    a = low
    if max(w * budget / filled[s] for s, w in weights(a).items()) > limit * (1 + 1e-12):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if max(w * budget / filled[s] for s, w in weights(mid).items()) > limit else (low, mid)
        a = high
    plan = []
    for s, w in weights(a).items():
        target = math.floor(w * budget + 0.5)
        epochs, rest = divmod(target, filled[s])
        for block in range(epochs + 1):
            order = sorted((int(hashlib.md5(f"{seed}:{block}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16), i, t) for i, x, t in rows if x == s)
            before = 0
            for place, (d, i, t) in enumerate(order, 1):
                if block < epochs or before < rest:
                    plan.append((i, s, block, place))
                before += t
    return sorted(plan, key=str)


@pytest.mark.parametrize("lift,limit,budget", [(0.5, 4.0, None), (0.9, 1.5, None), (1.0, 100.0, 5000), (0.0, 4.0, None)])
def test_mixing_against_brute_force(spark, monkeypatch, lift, limit, budget):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 7)
    rng = random.Random(6)
    rows = [(i, rng.choice(["big"] * 20 + ["mid"] * 5 + ["tiny", None]), rng.randrange(1, 60)) for i in range(300)] + [(300, "no tokens", 0)]
    df = spark.createDataFrame([(i, s, t, 5) for i, s, t in rows], "doc_id long, source string, words long, place int")
    plan, sources = mixing.mix(df, tokens=F.col("words"), lift=lift, max_epochs=limit, budget=budget)
    got = sorted([(r["doc_id"], r["source"], r["block"], r["place"]) for r in plan.collect()], key=str)
    assert got == own_mix(rows, lift, limit, budget)
    assert abs(sum(r["weight"] for r in sources.collect()) - 1) < 1e-9


def test_mixed_rows_follow_the_plan(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else "tiny", "x") for i in range(100)] + [(None, None, None, "x"), (101, "", "tiny", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _block string")
    plan, _ = mixing.mix(df, lift=0.9, max_epochs=3.0)
    out = mixing.mixed(df, lift=0.9, max_epochs=3.0)
    assert out.columns == df.columns and {r["_block"] for r in out.collect()} == {"x"}
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((r["doc_id"] for r in plan.collect()), key=str)
    assert mixing.mix(df.limit(0))[0].count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text IS NULL"))[0].count() == 0
    one = mixing.mix(df.where("source = 'big'"))[0]
    assert one.count() == 90  # a single source has its natural weight


# --- preference ----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, part string"


def test_preference_parts_and_masks(spark):
    turns = [(0, 0, "system", "Be kind."), (0, 1, "user", "Hi"), (0, 2, "assistant", "Hello!"), (0, 3, "user", "Bye"), (0, 4, "assistant", "Ciao"),
             (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "What?"),
             (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "more"), (4, 0, "user", "alone")]
    df = spark.createDataFrame([(*t, "own") for t in turns], TURNS)
    got = sorted(preference.segments(df, preference.neighbours(df)).collect(), key=lambda r: (r["pair_id"], r["part"], r["start"]))
    parts = {}
    for r in got:
        text = parts.setdefault((r["pair_id"], r["part"]), ["", []])
        assert r["start"] == len(text[0])
        text[0] += r["segment"]
        if r["mask_from"] is not None:
            text[1].append((r["mask_from"], r["mask_to"]))
    shown = {k: (t, [t[a:b] for a, b in m]) for k, (t, m) in parts.items()}
    assert shown[(0, "prompt")] == ("<|system|>\nBe kind.<|end|>\n<|user|>\nHi<|end|>\n", [])
    assert shown[(0, "chosen")][1] == ["Hello!<|end|>", "Ciao<|end|>"] and shown[(0, "rejected")][1] == ["What?<|end|>"]
    assert shown[(1, "prompt")][0] == "<|user|>\nsame<|end|>\n" and (1, "chosen") not in shown and shown[(1, "rejected")][1] == ["more<|end|>"]
    assert {r["pair_id"] for r in got} == {0, 1}


def test_preference_odd_rows(spark):
    turns = [(0, 0, None, None), (0, 0, None, None), (1, 0, "", ""), (0, 1, "assistant", "b"), (0, 1, "assistant", "a"), (1, 1, "assistant", "a"),
             (None, 0, "user", "x"), (0, None, "user", "x"), (1, 700, "assistant", "late")]
    df = spark.createDataFrame([(*t, "own") for t in turns], TURNS)
    got = [(r["part"], r["turn"], r["segment"], r["start"]) for r in preference.segments(df, preference.neighbours(df)).collect()]
    a, b = "<|assistant|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n"
    assert sorted(got) == sorted([("prompt", 0, "<||>\n<|end|>\n", 0), ("chosen", 1, a, 0), ("chosen", 1, b, len(a)), ("rejected", 1, a, 0),
                                  ("rejected", 700, "<|assistant|>\nlate<|end|>\n", len(a))])
    assert preference.segments(df.limit(0), preference.neighbours(df.limit(0))).count() == 0


# --- queries -------------------------------------------------------------------------


@pytest.mark.parametrize("key", ["op4_preference_formatting", "op9_source_mixing"])
def test_oracles(spark, key):
    out = check(entry.queries()[key](spark, SF), entry.oracle_sql()[key], duck(SF))
    assert out.startswith("ok"), out


def test_native_plans(spark):
    for key in ("op4_preference_formatting", "op9_source_mixing", "op10_quality_rules"):
        plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), key


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    now, kept = docs.unionByName(extra), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        if k < 4:
            assert now.columns == docs.columns, name
        now = now.cache()
        kept.append(now.count())
    assert kept[0] < docs.count() + 4 and kept[1] < kept[0] and kept[2] <= kept[1]
    assert now.where("NOT decodes").count() == 0 and now.where("size(ids) <> n_tokens").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
