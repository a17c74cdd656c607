import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from paramo.llm import periodic, queries


def brute(words, least=24, times=3):
    """Every maximal stretch at every lag, kept where no smaller period fits it."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            run = words[s:i + q]
            if len(run) >= max(least, times * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                out.append((s, len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        unit = [chr(97 + rng.randint(0, rng.choice([1, 2, 5, 25]))) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 20, 33, 40]))]
        unit *= rng.choice([1, 1, 2, 3, 4, 8, 30])
        out += unit[:len(unit) - rng.randint(0, 3)]
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (3, 3), (7, 3), (30, 4), (6, 5)])
def test_runs_equal_all_lags(least, times):
    rng, total = random.Random(least), 0
    for _ in range(120):
        texts = [some_words(rng) for _ in range(rng.randint(0, 4))]
        ids, starts = periodic.numbered(texts)
        got = periodic.runs(ids, starts, least, times).tolist()
        want = [[s + int(starts[i]), n, q] for i, w in enumerate(texts) for s, n, q in brute(w, least, times)]
        assert got == want
        total += len(want)
    assert total > 90


def test_nested_periods_that_repeat_inside_themselves():
    # a unit whose own grams all occur twice: neighbouring occurrences are not a period apart for short grams
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    words = (a + a + a + b + b + b + a + b) * 4
    ids, starts = periodic.numbered([words])
    assert periodic.runs(ids, starts, 24, 3).tolist() == [list(r) for r in brute(words)]


def test_find_rows_as_they_come(spark):
    far = "x y z " * 60_000
    rows = [(1, "one two " * 30, "own", 5), (1, "one two " * 30, "own", 5), (2, None, "own", 5), (3, "", "own", 5), (4, " \n\t", None, None),
            (None, "w\t" * 24, "own", 5), (5, "w " * 23, "own", 5), (6, far, "own", 5), (7, "é È " * 12 + " ", "own", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = {(r["doc_id"], r["n_words"]): r for r in periodic.find(df).collect()}
    assert periodic.find(df).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert periodic.find(df).count() == len(rows)
    assert [tuple(x) for x in got[1, 60]["runs"]] == [(0, 60, 2)] and got[1, 60]["collapsed"] == "one two"
    assert [(got[i, 0]["runs"], got[i, 0]["collapsed"]) for i in (2, 3, 4)] == [([], "")] * 3
    assert [tuple(x) for x in got[None, 24]["runs"]] == [(0, 24, 1)]
    assert got[5, 23]["runs"] == [] and got[5, 23]["collapsed"] == " ".join(["w"] * 23)
    assert [tuple(x) for x in got[6, 180_000]["runs"]] == [(0, 180_000, 3)] and got[6, 180_000]["text"] == far
    assert got[7, 25]["collapsed"] == "é È  "
    assert periodic.find(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.find(df, times=2)
    with pytest.raises(ValueError):
        periodic.find(df, "runs")


def test_strongest_breaks_ties_by_start_then_period(spark):
    rows = [([(0, 30, 3), (5, 40, 4), (9, 100, 10)],), ([(0, 24, 8), (2, 24, 8)],), ([(3, 33, 11), (3, 27, 9), (4, 1_000_000_007, 333_333_333)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "runs array<struct<start:int,length:int,period:int>>")
    got = [r[0] and tuple(r[0]) for r in df.select(periodic.strongest()).collect()]
    assert got == [(0, 30, 3), (0, 24, 8), (4, 1_000_000_007, 333_333_333), None, None]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(some_words(rng) + [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 90))]) for _ in range(120)]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (7, texts[7]), (None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def expected(i, text):
        w = re.findall("[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w)
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        return (i, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left(w, found).encode()).hexdigest())

    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t) > 5
