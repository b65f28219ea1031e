"""Operator 13 against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from strophe.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def neighbours(w, alphabet):
    out = set()
    for i in range(len(w) + 1):
        out |= {w[:i] + c + w[i:] for c in alphabet}
        if i < len(w):
            out |= {w[:i] + c + w[i + 1 :] for c in alphabet} | {w[:i] + w[i + 1 :]}
    return out - {w}


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def expected(n):
    alphabet, out = sorted({c for w in n for c in w}), {}
    for w, k in n.items():
        near = [x for x in neighbours(w, alphabet) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = best if best and n[best] >= 2 * k else None, len(near)
    rows = set()
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], near, n[form] if form else None))
    return rows


def texts(seed=0):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdéß") for _ in range(r.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(80):
            w = r.choice(stems[: r.randint(1, 60)])
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + r.choice("abcdéß") + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice("abcdéß") + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "\n", "1"]).join(words)))
    long = "a" * 20_000
    return rows + [(900, None), (901, ""), (902, "12 34 !"), (None, "nullid nullid nullid nullidd nullidd nullidd"), (903, f"{long} {long} {long} {long}b {long}b {long}b"), (5, rows[5][1]), (5, rows[5][1])]


def collected(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("shard", [50_000, 40])
def test_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "WORDS", shard)
    if shard < 50_000:
        monkeypatch.setattr(spelling, "BLOCK", 3000)  # several blocks
    rows = texts()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = spelling.spelling_variants(docs)
    want = expected_long(counted(rows))
    assert collected(got) == want and got.count() == len(want)


def expected_long(n):
    """``expected`` with the very long words, which have only each other, put in by hand."""
    long = {w: k for w, k in n.items() if len(w) > 1000}
    assert sorted(map(len, long)) == [20_000, 20_001]
    return expected({w: k for w, k in n.items() if w not in long}) | {(w, None, w, k, 1, None) for w, k in long.items()}


def test_walk_finds_each_neighbour_once():
    r = random.Random(3)
    for size in (1, 2, 5, 40, 400):
        words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 8))) for _ in range(size)})
        trie = spelling.Trie(spelling.encoded(words, [1] * len(words)))
        assert (trie.words, trie.counts) == (words, [1] * len(words))
        for w in words + ["", "a", "abab", "bbbbbbbbb"]:
            assert sorted(trie.near(w)) == sorted(i for i, x in enumerate(words) if x in neighbours(w, "ab"))


def test_prefixes_of_each_other():
    words = ["a" * k for k in range(1, 3000)]
    trie = spelling.Trie(spelling.encoded(words, [1] * len(words)))
    assert sorted(trie.near("a" * 1500)) == [1498, 1500]


def test_ties_chains_and_odd_rows(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "qqqqq": 4, "qqqqr": 7}
    df = spark.createDataFrame([*n.items(), (None, 5), ("nothing", None)], "word string, n int")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert {tuple(r) for r in got.values()} == expected(n)
    assert got["aaaaa"].root == "aabbb" and got["zzzzz"].form == "zzzzx" and got["qqqqq"].form is None
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)
