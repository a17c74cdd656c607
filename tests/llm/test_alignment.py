import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paramo.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def letters():
    """The byte that each letter of a byte-level vocabulary stands for."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def groups_of(text, a, b):
    """The groups of a whole text by walking over its bytes; None if a tokenizer changes it."""
    if not text:
        return None
    byte_of = letters()
    tokens_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in tokens_a) != whole or b"".join(x for _, x in tokens_b) != whole:
        return None
    out, x, y, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
    while i < len(tokens_a) or j < len(tokens_b):
        if at_a <= at_b:
            x.append(tokens_a[i][0])
            at_a += len(tokens_a[i][1])
            i += 1
        else:
            y.append(tokens_b[j][0])
            at_b += len(tokens_b[j][1])
            j += 1
        if at_a == at_b:
            out.append((x, y))
            x, y = [], []
    return out


def expected(texts, a, b):
    found = [groups_of(t, a, b) for t in texts]
    links = [[(p, q) for x, y in g or [] for p in x for q in y] for g in found]
    count = Counter(pair for row in links for pair in set(row))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for g, row in zip(found, links):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or [])
        out.append((sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(row),
                    sum(count[x] == best[x[0]] for x in row), sum(count[x] for x in row), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


def some_texts(n):
    rng = random.Random(5)
    parts = ["the", "loweient", "Ünïcödé", "naïve", "don't", "we'll", "x=1;", "a.b", "12345", "３", "日本語のテキスト", "🙂👍🏽", "...", "--", "<|endoftext|>", "<s>", "</s>",
             "<0x0A>", "ΑΒΓ", "мир", "क्षि", "é", " ", "　", "\x1c", "\x85", " ", "\x00", "​", "﻿", "Word", "THING", "ing", "_", "'s", "(a)", "%%%"]
    blanks = [" ", " ", " ", " ", "  ", "   ", "\n", "\n\n", "\t", " \n ", "\r\n", "", "\n  ", "  \t"]
    out = []
    for k in range(n):
        text = "".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randint(0, 60)))
        out.append(rng.choice(["", "", " ", "\n", "  "]) + text + (" a▁b" if k % 17 == 0 else ""))
    return out


def test_segments_give_the_tokens_of_whole_texts(libraries):
    a, b = libraries
    t = alignment.tokens(*PATHS)
    assert t.by_segment and t.ranked is not None
    for text in some_texts(1500):
        segments = t.segments(text)
        assert "".join(segments) == " " + text
        assert [i for x in t.ids_a(segments) for i in x] == a.encode(" " + text, add_special_tokens=False).ids
        if text and "▁" not in text:
            assert [i for x in t.ids_b(segments) for i in x] == b.encode(text)
    far = "ab" * alignment.LONG
    assert t.ids_a([far]) == [a.encode(far, add_special_tokens=False).ids]
    assert [t.bytes_a[i] for i in range(256)] == [bytes([letters()[a.id_to_token(i)]]) for i in range(256)]


def test_perfect_hash_gives_every_key_a_place_of_its_own():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 31, n))
        h = alignment.PerfectHash.build(keys)
        assert sorted(h.places(keys).tolist()) == list(range(len(keys)))
    assert sum(len(raw) for _, raw in h.bitmaps) * 8 < 4 * len(keys)


def test_wide_groups_count_alike(monkeypatch):
    t = alignment.tokens(*PATHS)
    texts = some_texts(200)
    plain = alignment.Aligner(t, True, True)
    monkeypatch.setattr(alignment, "WIDE", 0)
    wide = alignment.Aligner(t, True, True)
    for x, y in zip(plain.distinct(texts), wide.distinct(texts)):
        assert x.tolist() == y.tolist()
    for x, y in zip(plain.facts_of(texts)[1], wide.facts_of(texts)[1]):
        assert x.tolist() == y.tolist()
    assert plain.pairs.all[:plain.pairs.n].tolist() == wide.pairs.all[:wide.pairs.n].tolist()


def test_a_task_may_forget_what_it_knows(monkeypatch):
    t = alignment.tokens(*PATHS)
    texts = some_texts(60)
    whole = alignment.Aligner(t, True, False).facts_of(texts)
    monkeypatch.setattr(alignment, "KNOWN", 5)
    monkeypatch.setattr(alignment, "NEW", 3)
    short = alignment.Aligner(t, True, False)
    pieces = [short.facts_of([x]) for x in texts]
    assert [p[2][0] for p in pieces] == whole[2]
    assert [[int(c[0]) for c in p[1]] for p in pieces] == [[int(c[i]) for c in whole[1]] for i in range(len(texts))]


@pytest.mark.parametrize("most", [alignment.PART, 700])
def test_equals_brute_force(spark, libraries, most):
    texts = some_texts(250) + [None, "", " ", "▁", "a", "a", "the the the", "word " * 30_000]
    rows = [(i if i % 50 else None, t, "own", 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups_sha256 string, n_best int")
    got = alignment.align(df.withColumnRenamed("doc_id", "key"), *PATHS, most=most)
    assert got.columns[0] == "key" and len(got.columns) == 8
    want = [(r[0], *e) for r, e in zip(rows, expected(texts, *libraries))]
    assert sorted(map(tuple, got.select("key", *NUMBERS, "groups_sha256").collect()), key=str) == sorted(want, key=str)
    assert alignment.align(df.limit(0), *PATHS, most=most).collect() == []
    with pytest.raises(ValueError):
        alignment.align(df, *PATHS, "groups_sha256")


def test_query_reads_whole_documents(spark, libraries):
    got = queries.QUERIES["op12_cross_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", *NUMBERS, "groups_sha256"] or set(got.columns) == {"doc_id", *NUMBERS, "groups_sha256"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = [(d["doc_id"], *e) for d, e in zip(docs, expected([d["text"] for d in docs], *libraries))]
    assert sorted(map(tuple, got.select("doc_id", *NUMBERS, "groups_sha256").collect())) == sorted(want)
