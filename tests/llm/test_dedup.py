import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from paramo.llm import simhash, spans, suffixes

DOCS = "doc_id long, text string, fingerprint string, n_removed long, _id string, _fp long"  # names that clash


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", 7, "u", 1) for i, t in rows], DOCS)


def words(rng, n):
    return [rng.choice("the of and to in that was for on with as by at from this".split()) + str(rng.randrange(400)) for _ in range(n)]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def own_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0D]+", low(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def texts_with_copies():
    rng = random.Random(3)
    rows = []
    for k in range(60):
        base = words(rng, rng.randrange(1, 300))
        for c in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            if c and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy) if c % 2 else "\t".join(copy).title())
    rows += [None, "", " \n\t", "One", "one", "ONE two", "é È word", "long " * 90_000]
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [8, 32768])
def test_simhash_against_all_pairs(spark, tile):
    rows = texts_with_copies()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows), tile=tile).collect()}
    prints = {i: own_fingerprint(t) for i, t in rows}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert least_reachable(prints, linked) == {i: r["component_id"] for i, r in got.items()}


def test_simhash_radius_across_cells():
    rng = random.Random(5)
    import numpy as np
    base = [rng.getrandbits(64) for _ in range(50)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for b in base]
    values = np.array(prints, np.uint64).view(np.int64)
    u, v = simhash.tile_links(values, None, 3)
    mine = least_reachable(values.tolist(), zip(u.tolist(), v.tolist()))
    brute = least_reachable(values.tolist(), [(a, b) for a in values.tolist() for b in values.tolist()
                                              if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3])
    assert mine == brute


def test_simhash_rows_without_ids_and_repeats(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "quite another text here"), (9, None)]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 9)], key=str)
    kept = simhash.keep_first(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fingerprint", "n_removed", "_id", "_fp"]
    assert {(r["fingerprint"], r["_id"], r["_fp"]) for r in kept.collect()} == {("own", "u", 1)}
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted(
        [(5, "a b c d e"), (None, "quite another text here"), (9, None)], key=str)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_first(docs(spark, [])).count() == 0


def test_groups_that_share_an_id_leave_one_document(spark):
    a, b, c = ("the first text of all of them " * 3, "a second one that says something else " * 3, "and the third, of its own " * 3)
    rows = [(5, a), (2, a), (5, b), (7, b), (9, c), (9, c), (11, "zz " + c), (11, "aa " + c * 9)]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(docs(spark, rows)).collect())
    # 2, 5 and 7 are one group by the two texts of 5
    assert [i for i, _ in kept if i < 9] == [2] and kept[0] == (2, a) and (9, c) in kept and len([1 for i, _ in kept if i == 9]) == 1
    assert [t for i, t in kept if i == 11] in ([], ["aa " + c * 9])


# --- sentence spans ------------------------------------------------------------------


def own_cuts(text):
    """Sentences by a walk over the words; in those of 12 words or more, the least CRC-32 of every 12 words in a row ends a piece."""
    words = list(re.finditer("[^\x20\x09-\x0D]+", text or ""))
    ends, at = set(), 0
    for k, w in enumerate(words):
        gap = text[w.end():words[k + 1].start()] if k + 1 < len(words) else ""
        if k + 1 == len(words) or "\n" in gap or "\r" in gap or w.group()[-1] in ".!?":
            least = range(at, k + 2 - 12)
            ends |= {min(range(a, a + 12), key=lambda i: (zlib.crc32(words[i].group().encode()), i)) for a in least} | {k}
            at = k + 1
    found, at = [], 0
    for k in sorted(ends):
        found.append((words[at].start(), " ".join(w.group() for w in words[at:k + 1])))
        at = k + 1
    return found


def own_spans(rows, least_sentences=3, least_words=28):
    """Every run compared with every other by its words."""
    places = defaultdict(list)
    for i, t in sorted(rows):
        bodies = [b for _, b in own_cuts(t)]
        for a in range(len(bodies)):
            for b in range(a + least_sentences, len(bodies) + 1):
                run = bodies[a:b]
                if sum(len(x.split()) for x in run) >= least_words:
                    places[tuple(run)].append((i, a, b))
                    break
    gone = defaultdict(set)
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b))
    return gone


def passages(rng):
    def sentence(n=None):
        return " ".join(words(rng, n or rng.randrange(1, 14))).capitalize() + rng.choice([".", "!", "?", ".\n"])

    shared = [" ".join(sentence() for _ in range(8)) for _ in range(4)] + [" ".join(words(rng, 90))]
    rows = []
    for i in range(40):
        parts = [sentence() for _ in range(rng.randrange(1, 12))]
        for s in rng.sample(shared, rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), s)
        rows.append((i, " ".join(parts)))
    return rows + [(40, rows[3][1]), (41, None), (42, ""), (43, " \n "), (44, "No end here"), (45, "x. " * 5000)]


def test_spans_against_all_runs(spark):
    rows = passages(random.Random(11))
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs(spark, rows)).collect()}
    gone = own_spans(rows)
    for i, t in rows:
        raw = (t or "").encode()
        starts = [len(t[:s].encode()) for s, _ in own_cuts(t)]
        edges = starts + [len(raw)]
        want = raw[:edges[0]] + b"".join(raw[edges[k]:edges[k + 1]] for k in range(len(starts)) if k not in gone[i])
        assert (got[i]["text"], got[i]["n_removed"]) == (None if t is None else want.decode(), len(gone[i])), i
    assert sum(map(len, gone.values())) > 50


def test_sentences_cover_the_text():
    for i, t in passages(random.Random(1)):
        raw = (t or "").encode()
        starts, counts = spans.starts_of(raw)
        bodies, _ = spans.sentences(raw)
        assert [(len((t or "")[:s].encode()), b) for s, b in own_cuts(t)] == [(int(s), b.decode()) for s, b in zip(starts, bodies)]
        assert counts.tolist() == [len(b.split()) for b in bodies]


def test_wide_letters_count_as_words():
    text = "これは長い文です。" * 2 + "短い。Latin words here."
    bodies, counts = spans.sentences(text.encode())
    assert [b.decode() for b in bodies] == ["これは長い文です。", "これは長い文です。", "短い。", "Latin words here."]
    assert counts.tolist() == [1 + 9 // 2, 1 + 9 // 2, 1 + 3 // 2, 3]


def test_spans_rows_without_ids_and_repeats(spark):
    text = "".join(f"One{k} two three four five six seven eight nine ten. " for k in range(3))
    rows = [(2, text), (2, text), (None, text), (1, "Before it. " + text + "After it.")]
    out = spans.remove_repeats(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "fingerprint", "_id", "_fp", "n_removed", "emptied"]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in out.collect()), key=str)
    # the row without an id counts as first, so all others lose the passage
    assert got == sorted([(2, 3), (2, 3), (None, 0), (1, 3)], key=str)
    assert spans.without_repeats(docs(spark, rows)).count() == 2
    assert spans.remove_repeats(docs(spark, [])).count() == 0


def placed(rng, passage, stops):
    """The passage in mid-sentence of a text of its own, whose sentences end every ``stops`` words if at all."""
    def around(n):
        found = [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
        return [w + "." if stops and k % stops == stops - 1 else w for k, w in enumerate(found)]

    before, after = around(rng.randrange(30, 60)), around(rng.randrange(30, 60))
    return [w.rstrip(".") if k >= len(before) - 5 else w for k, w in enumerate(before)], passage, after


@pytest.mark.parametrize("length,stops", [(51, 0), (60, 0), (75, 0), (51, 17), (60, 19), (80, 22), (51, 9)])
def test_passages_share_spans_wherever_they_stand(length, stops):
    rng = random.Random(length * 100 + stops)
    for _ in range(300):
        shift = rng.randrange(stops or 1)
        passage = [f"w{rng.randrange(10 ** 9)}" + ("." if stops and (k + shift) % stops == stops - 1 else "") for k in range(length)]
        one, two = (" ".join(sum(placed(rng, passage, stops), [])).encode() for _ in range(2))
        found = []
        for text in (one, two):
            bodies, counts = spans.sentences(text)
            first, sizes, hashes = spans.runs(bodies, counts, 3, spans.LEAST_WORDS)
            found.append({h: b" ".join(bodies[a:a + k]) for h, a, k in zip(map(tuple, hashes.tolist()), first.tolist(), sizes.tolist())})
        common = found[0].keys() & found[1].keys()
        assert common and all(found[0][h] in " ".join(passage).encode() for h in common)


def test_passages_go_and_short_repeats_stay(spark):
    """Of 60 passages of over 50 words each copy but the first is cut; of 60 texts that share up to 27 words with others none is."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    rows, shared = [], fresh(27)
    for k in range(60):
        passage = fresh(rng.randrange(51, 80))
        rows += [(2 * k, " ".join(fresh(40) + passage + fresh(40))), (2 * k + 1, " ".join(fresh(25) + passage + fresh(60)))]
    rows += [(1000 + k, " ".join(fresh(50) + shared[:rng.randrange(12, 28)] + fresh(50))) for k in range(60)]
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs(spark, rows)).collect()}
    assert all(got[2 * k]["n_removed"] == 0 and got[2 * k + 1]["n_removed"] >= 3 for k in range(60))
    assert all(got[1000 + k]["text"] == dict(rows)[1000 + k] for k in range(60))


def test_spans_of_passages_in_mid_sentence(spark):
    rng = random.Random(7)
    rows, parts = [], []
    for k in range(30):
        length, stops = rng.randrange(51, 90), rng.choice([0, 0, 9, 17, 22])
        passage = [f"w{rng.randrange(10 ** 9)}" + ("." if stops and j % stops == 3 else "") for j in range(length)]
        for i in (2 * k, 2 * k + 1):
            parts.append(placed(rng, passage, stops))
            rows.append((i, " ".join(sum(parts[-1], []))))
    got = {r["doc_id"]: r["text"].split() for r in spans.remove_repeats(docs(spark, rows)).collect()}
    for i, (before, passage, after) in enumerate(parts):
        kept = [w for w in passage if w in got[i]]
        assert got[i] == before + kept + after  # no word outside the passage goes
        assert kept == passage if i % 2 == 0 else len(passage) - len(kept) >= 12


# --- suffix arrays -------------------------------------------------------------------


def repeated_starts(segments, length):
    places = defaultdict(list)
    for i, s in enumerate(segments):
        for p in range(len(s) - length + 1):
            places[s[p:p + length]].append((i, p))
    return {x for v in places.values() if len(v) > 1 for x in v}


def test_two_stage_sorting_against_all_windows():
    rng = random.Random(0)
    for _ in range(120):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(256)), b"the quick"])
        pool = [bytes(rng.choice(letters) for _ in range(rng.randint(30, 120))) for _ in range(3)]
        segments = [s for s in (b"".join(rng.choice(pool) if rng.random() < .5 else bytes(rng.choice(letters) for _ in range(rng.randint(0, 60)))
                                         for _ in range(4)) for _ in range(rng.randint(1, 7))) if len(s) >= 40]
        if segments:
            got = {(i, p) for i, a, b in suffixes.repeated_windows(segments, 40) for p in range(a, b)}
            assert got == repeated_starts(segments, 40)


def byte_texts():
    rng = random.Random(8)
    passage = [" ".join(words(rng, 40)) for _ in range(3)]
    rows = []
    for i in range(50):
        parts = [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice([*passage, "ünïcödé " * 12, "x" * 300]))
        rows.append((i, " ".join(parts)))
    return rows + [(50, rows[4][1]), (51, None), (52, ""), (53, "a" * 99), (54, "a" * 5000), (55, "ab" * 300)]


@pytest.mark.parametrize("wide", [1000, 1])
def test_suffix_dedup_against_all_strings(spark, monkeypatch, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    length = 100
    rows = byte_texts()
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs(spark, rows), length=length).collect()}
    raw = [(t or "").encode() for _, t in rows]
    starts = repeated_starts(raw, length)
    for k, (i, _) in enumerate(rows):
        gone = [False] * len(raw[k])
        for p in range(len(raw[k])):
            if (k, p) in starts:
                gone[p:p + length] = [True] * length
        assert bytes(got[i]["kept"]) == bytes(b for b, g in zip(raw[k], gone) if not g)
        assert got[i]["n_bytes"] == len(raw[k])
        spans_ = [s.asDict() for s in got[i]["spans"]]
        assert [x for s in spans_ for x in range(s["lo"], s["hi"])] == [p for p, g in enumerate(gone) if g]
        assert all(a["hi"] < b["lo"] for a, b in zip(spans_, spans_[1:]))


def test_suffix_dedup_rows_without_ids_and_repeats(spark):
    a, b = "".join(map(chr, range(33, 126))) * 2, "z" * 30 + "q"
    rows = [(1, a), (1, a), (None, a[40:170]), (2, b), (2, b + "!")]
    out = suffixes.remove_repeats(docs(spark, rows), length=100)
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert got == sorted([(1, 186, 56), (1, 186, 56), (None, 130, 0), (2, 31, 31), (2, 32, 32)], key=str)
    assert suffixes.remove_repeats(docs(spark, []), length=100).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs(spark, rows), length=8)


def test_digest_of_whole_text(spark):
    from paramo.llm.queries import QUERIES
    row = QUERIES["op2_suffix_array_dedup"](spark, "/root/testdata/sf0.001").where("n_removed = 0").join(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").select("text", "kept_sha256").where(F.col("text").isNotNull()).first()
    assert hashlib.sha256(row["text"].encode()).hexdigest() == row["kept_sha256"]
