"""Rules that the given tables don't exercise, on hand-written rows."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strophe.config import Config
from strophe.functions import phonetics, reports, scheme, text
from strophe.operators import augment, lines, merges, originality, profiles, quality, retrieval, sequences, tokenizers, vector_index
from strophe.operators.following import numbered, numbered_values, with_following
from strophe.plans import queries
from strophe.sources import corpora, runs
from strophe.streaming.run_metrics import read_stream, windowed, write_stream


def one(spark, column, **values):
    types = {str: "string", int: "long", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_cleaners(spark):
    t = "Song Lyrics\n[Verse 1]\n42\nYo\n!!\nI See you\nYou might also like\nSee them Live\n  kept line \n12Embed"
    assert one(spark, text.clean_page(F.col("t")), t=t) == "Yo\nI See you\nkept line"
    assert one(spark, text.clean_user_text(F.col("t")), t="[Hook]\n--\nYo\n") == "Yo"
    assert one(spark, text.clean_web_text(F.col("t")), t="See me\nYo\nwriter\n17\nfine line") == "fine line"
    assert one(spark, text.style_lines(F.col("t")), t="Yo\n[x]\nabc") == ["abc"]
    assert one(spark, text.verse_lines(F.col("t")), t="I See you\nabc") == ["abc"]
    assert one(spark, text.generated_lines(F.col("t"), 2), t="a\nline 1\nThis is it\nline 2\nline 3\nVerse 2\nx") == ["line 1", "line 2"]


def test_words(spark):
    assert one(spark, text.end_word(F.col("t")), t="we ride 24/7 !") == "ride"
    assert one(spark, text.end_word(F.col("t")), t="24/7 !") is None
    assert one(spark, text.overlap(F.lit("abcdefg"), F.lit("abcdefg")), t="") == 1.0
    assert one(spark, text.overlap(F.lit("abc"), F.lit("abcdefg")), t="") == 0.0
    assert one(spark, F.regexp_count(F.col("t"), F.lit(text.CONTRACTION)), t="ain't runnin' y'all") == 2
    assert one(spark, text.bar_split(F.col("t")), t="this is the left side of it, and here is the right side of it") == "this is the left side of it\nand here is the right side of it"
    assert one(spark, text.bar_split(F.col("t")), t="short, line") is None
    assert one(spark, text.generated_part(F.col("t")), t="<|verse|>a<|verse|>b<|end|>c<|end|>") == "b"
    assert one(spark, text.page_text(F.col("t")), t="<style>x</style><p>a &amp; b<br>c</p>") == "a & b\nc"


def test_phonetics(spark):
    assert one(spark, phonetics.phone_suffix(F.col("p")), p=["M", "AH1", "N", "IY0"]) == "IY0"
    assert one(spark, phonetics.phone_suffix(F.col("p")), p=["M"]) is None
    assert [one(spark, phonetics.spelled_syllables(F.col("w")), w=w) for w in ("zzz", "-", "banana")] == [1, 1, 3]
    assert [one(spark, phonetics.syllable_bucket(F.col("n")), n=n) for n in (6, 7, 12, 15, 16)] == [0, 1, 2, 3, 4]
    ids = {r.symbol: r.id for r in phonetics.phonemes(spark).collect()}
    assert len(ids) == 70 and (ids["AA0"], ids["AY2"], ids["B"], ids["CH"], ids["D"], ids["DH"], ids["EH0"], ids["ZH"]) == (1, 18, 19, 20, 21, 22, 23, 69)
    assert one(spark, phonetics.words_rhyme(F.lit("Ride"), F.lit("side"), F.lit("AY1 D"), F.lit("AY1 D")), t="")
    assert not one(spark, phonetics.words_rhyme(F.lit("Ride"), F.lit("ride"), F.lit("AY1 D"), F.lit("AY1 D")), t="")


def test_scheme(spark):
    cases = {"aabb": "AABB", "abab": "ABAB", "abba": "ABBA", "aaaa": "AAAA", "aabc": "irregular", "a-aa": "unknown"}
    for s, want in cases.items():
        cols = [F.lit(None if c == "-" else c) for c in s]
        assert one(spark, scheme.classify(*cols), t="") == want
    assert scheme.groups("AABB", 8) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert scheme.groups("free", 3) == [0, 1, 2]
    assert scheme.groups("AB", 4) == [0, 1, 2, 3]
    assert len(scheme.groups("AAAA", 6, scheme.SAMPLING)) == 6


def test_following_crosses_documents_and_ranges(spark):
    rows = [(s, d, [f"{s}{d}.{i}" for i in range((d * 7) % 4)]) for s in "ab" for d in range(40)]
    df = spark.createDataFrame(rows, "g string, d long, items array<string>")
    for parts in (1, 5, 20):
        got = {(r.g, r.d): r.after for r in with_following(df, "g", "d", "items", 3, "after", parts).collect()}
        for s, d, items in rows:
            if items:
                assert got[s, d] == [x for a, b, c in rows if a == s and b > d for x in c][:3]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line {i:02d}" for i in range(20)))], "doc_id long, text string")
    assert [len(r.lines) for r in lines.chunks(df, text.style_lines(F.col("text")), 16, 8, 4, "doc_id").orderBy("chunk_id").collect()] == [16, 12, 4]
    assert [len(r.lines) for r in lines.verse_chunks(df, "doc_id").collect()] == [16]


def test_spam_paths_agree(spark):
    """Both ways give the same rows, ids that occur twice and null ids among them."""
    own = lambda i: "\n".join(f"a line of text {i} and of no other, number {j}" for j in range(6))
    ids = [0, 1, 1, None, None, 5, 6]
    df = spark.createDataFrame([(d, "s", f"{own(i)}\nbuy tickets now\nown line {i}") for i, d in enumerate(ids)], "doc_id long, source string, text string")
    a, b = (sorted(map(tuple, lines.without_spam(df, small=n).collect()), key=str) for n in (1000, 0))
    assert a == b and len(a) == len(ids)
    assert all("buy tickets" not in r[2] and r[2].endswith(f"own line {r[2][-1]}") for r in a)


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "alone"), (1, "twice"), (2, "twice"), (1, "another of id 1"), (None, "here too"), (7, "here too"), (8, None), (9, None), (3, "same row"), (3, "same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lines.exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, "alone"), (1, "twice"), (1, "another of id 1"), (7, "here too"), (8, None), (3, "same row")], key=str)


def test_exact_dedup_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 7, 8), (2, "a", 9, 8)], "doc_id long, text string, _key int, _key_k int")
    assert lines.exact_dedup(df).collect() == [(1, "a", 7, 8)] and lines.exact_dedup(df).columns == df.columns


def test_lines_end_in_many_ways(spark):
    t = "one line\r\ntwo line\rthree line\x0bfour line\u2028five line\x85six line"
    assert len(one(spark, text.style_lines(F.col("t")), t=t)) == 6
    assert one(spark, text.clean_page(F.col("t")), t="X Lyrics\r\nkept line\r\n") == "kept line"
    assert one(spark, text.generated_lines(F.col("t"), 9), t="a b\x0bc\nd e") == ["a b\x0bc", "d e"]


def test_numbered_is_a_row_number(spark):
    rows = [("a", d % 40 if d % 9 else None, d) for d in range(200)] + [(None, 3, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "g string, o long, d long")
    for parts in (1, 7):
        got = numbered(df, "g", "o", "d", parts=parts).collect()
        for g in ("a", None):
            mine = [r for r in got if r.g == g]
            order = sorted(mine, key=lambda r: (r.o is not None, r.o or 0, r.d))
            assert [r._no for r in order] == list(range(1, len(mine) + 1)) and {r._all for r in mine} == {len(mine)}


def test_numbered_values_are_in_order(spark):
    values = [None, "", "z", "é", "𝄞", *(f"w{i * 7919 % 500}" for i in range(2000))]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    known = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            assert {r.v: r.id for r in numbered_values(df, "v").collect()} == {v: i + 1 for i, v in enumerate(known)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert numbered_values(df.limit(0), "v").count() == 0


def test_long_texts_take_linear_time(spark):
    import time

    def seconds(n, f):
        df = spark.createDataFrame([("s", 1, "\n".join(f"a line of words that ends in {w}" for w in ("ride", "side", "stone", "alone") * (n // 4)))], "source string, doc_id long, text string")
        f(df).count()
        best = []
        for _ in range(2):
            began = time.time()
            f(df).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        return min(best)

    for f in (lines.scheme_windows, lambda d: sequences.newline_labels(d, "doc_id"), lambda d: sequences.words_at_boundaries(d, "doc_id"), lambda d: augment.full_chunks(d, "source", "doc_id")):
        assert seconds(16_000, f) <= 2.5 * seconds(8_000, f) + 0.5


def test_metrics(spark):
    w = lambda t: text.words(F.lit(t))
    assert one(spark, quality.distinct_n(w("a b a b"), 1), t="") == 0.5
    assert abs(one(spark, quality.distinct_n(w("a b a b"), 2), t="") - 2 / 3) < 1e-12
    assert one(spark, quality.distinct_n(w("a b a b"), 5), t="") == 0.0
    v = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["the cat", "a hat"] * 4)], "id long, lines array<string>")
    got = {r.id: r for r in quality.score_verses(v, "AABB", 8).collect()}
    assert got[1].score == -1.0
    assert got[2].pairs == 22 and got[2].hits == 4 and got[2].score == 22 + 2 + 0.5
    long = spark.createDataFrame([(1, ["a cat", "a hat"] * 300)], "id long, lines array<string>")
    got = quality.score_verses(long, "ABAB", 8).first()
    assert got.n_lines == 600 and got.pairs == sum(min(4, 599 - i) for i in range(600)) and got.hits == 10  # the pattern's lines only
    best = quality.best_candidate(quality.score_verses(v, "AABB", 8).withColumn("g", F.lit(1)), "g", "lines", "id").first()
    assert best.n_lines == 8


def test_decoding(spark):
    lg = spark.createDataFrame([(0, t, x) for t, x in enumerate((3.0, 2.0, 2.0, 1.0))], "step long, token int, logit double")
    assert sequences.top_k_mask(lg, "step", 2).count() == 3
    assert [r.token for r in sequences.top_p_mask(sequences.softmax(lg, "step"), "step", "token", 0.1).collect()] == [0]
    assert one(spark, F.array_size(sequences.recent_tokens(F.sequence(F.lit(1), F.lit(500)))), t="") == 200
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((5, 4, 6, 7, 3))], "run int, step int, loss double")
    assert [r.since_best for r in quality.evals_since_best(rows, "run", "step", "loss").orderBy("step").collect()] == [0, 0, 1, 2, 0]
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate("abacaa")], "v int, line_no int, suffix string")
    assert {(r.line_no, r.other_no) for r in sequences.rhyme_pairs(s, "v").collect()} == {(0, 2), (0, 4), (2, 4), (2, 5), (4, 5)}
    d = spark.createDataFrame([(1, "ab cd\nef")], "id int, text string")
    assert [(r.pos, r.word) for r in sequences.words_at_boundaries(d, "id").orderBy("pos").collect()] == [(2, "ab"), (5, "cd"), (7, "e")]


def test_tokenizers(spark):
    d = spark.createDataFrame([(1, "low low lower"), (2, "new newer")], "doc_id long, text string")
    done, vocab = tokenizers.bpe_train(d, 3)
    assert done[0] == ("l", "o") and done[1] == ("lo", "w")
    names = {i: t for t, i in vocab.items()}
    for r in tokenizers.bpe_encode(d, done, vocab).join(d, "doc_id").collect():
        assert "".join(names[i] for i in r.tokens) == r.text
    v = tokenizers.char_vocab(d)
    back = {r.id: r.char for r in v.collect()}
    for r in tokenizers.char_encode(d, v, "text").collect():
        assert "".join(back[i] for i in r.tokens) == r.text
    trie = {r.prefix: (r.next_chars, r.is_word) for r in tokenizers.prefix_table(spark.createDataFrame([("an",), ("ant",), ("at",)], "word string")).collect()}
    assert trie["a"] == (["n", "t"], False) and trie["an"] == (["t"], True)


def test_characters_there_and_back(spark):
    texts = ["a\u00e9\U0001f600b", "", None, "\u4e2d\n a", "\U0001f600"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = tokenizers.char_vocab(d)
    assert [(r.char, r.id) for r in v.orderBy("id").collect()] == [(c, i) for i, c in enumerate(sorted(set("".join(t or "" for t in texts))))]
    ids = {r.char: r.id for r in v.collect()}
    coded = tokenizers.char_encode(d, v, "doc_id")
    assert {r.doc_id: r.tokens for r in coded.collect()} == {i: None if t is None else [ids[c] for c in t] for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokenizers.char_decode(coded, v, "doc_id").collect()} == dict(enumerate(texts))
    odd = spark.createDataFrame([(1, [0, None, 99, -1])], "doc_id long, tokens array<long>")
    assert tokenizers.char_decode(odd, v, "doc_id").first().text == "\n???"
    plans = [coded._jdf.queryExecution().toString(), tokenizers.char_decode(coded, v, "doc_id")._jdf.queryExecution().toString()]
    assert not any("split(" in p or "lambda" in p for p in plans)  # no array of characters
    with pytest.raises(Exception, match="not in the vocabulary"):
        tokenizers.char_encode(spark.createDataFrame([(1, "z")], "doc_id long, text string"), v, "doc_id").collect()


def times(df, *parts):
    """How often each part stands in the optimised plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [plan.count(p) for p in parts]


def test_bars_are_split_once(spark, tmp_path):
    a, b = "word " * 5, "other " * 4
    rows = [(1, f"{a}, {b}\nshort"), (2, f"{a}\t AND  {b}"), (3, f"ab, {b}{b}"), (4, "x" * 50), (5, None), (6, f"{a}'cause {b}so {a}\r\nthen")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["bar_split"](spark, str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{a.strip()}\n{b.strip()}\nshort", 2: f"{a.strip()}\n{b.strip()}", 6: f"{a.strip()}\n{b}so {a}".strip() + "\nthen"}
    assert times(out, "cause") == [1]


def test_augmented_texts_are_worked_out_once(spark):
    d = spark.createDataFrame([(1, "s", "the a\nb\nc\nd of it")], "doc_id long, source string, text string")
    assert times(augment.swapped_synonyms(d, "doc_id"), "regexp_extract_all") == [1]
    assert times(augment.shuffled_blocks(d, "doc_id"), "array_sort(", "split(") == [1, 1]


def test_completions_cut_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "low new  Blow\tnew"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["rhyme_completion_tokens"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("ew", 1, "5"), ("ow", 2, "5")]
    assert "documents.parquet" not in out._jdf.queryExecution().toString()  # words are written, then read


def test_pages_are_cleaned_once(spark, tmp_path):
    noise = ["You might also like this", "Get tickets as low as 5", "See them Live", "007", "3Embed", "2 Contributors", "[Verse]", "--", "12"]
    kept = ["See them", "Live See", "Embedded", "7 up", "é", "the last line " * 10]
    body = "\r\n".join(["A Lyrics"] + [x for y in zip(noise, kept, strict=False) for x in y] + noise)
    spark.createDataFrame([(1, body), (2, "short"), (3, None), (4, body.replace("\r\n", "\n"))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["clean_documents"](spark, str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == dict.fromkeys((1, 4), "\n".join(x.strip() for x in kept))
    assert times(out, "Contributors", "You might also like|Get tickets") == [1, 0]


def test_line_ends_and_their_labels(spark):
    texts = ["a b\n\n\U0001f600 hm, the\tend!\nlast", "", None, "\n", "no end", "x y \n-- \t\n\u00e9t\u00e9\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, p, t[:p].split("\n")[-1]) for i, t in enumerate(texts) if t for p, c in enumerate(t) if c == "\n")
    ends = sequences.line_ends(d, "doc_id")
    assert sorted(map(tuple, ends.collect())) == want
    assert "lambda" not in ends._jdf.queryExecution().toString()
    line = spark.createDataFrame([(x,) for x in (*(x for _, _, x in want), None, "--", "a'e-o yy  B", "hm 'tis (strengths) 42", "\u0130st")], "line string")
    per_word = F.aggregate(F.transform(text.words(F.col("line")), lambda w: phonetics.spelled_syllables(text.bare_word(w))), F.lit(0), lambda s, x: s + x)
    last = text.bare_word(F.try_element_at(text.words(F.col("line")), F.lit(-1)))
    got = line.select(phonetics.line_syllables(F.col("line")).alias("n"), per_word.alias("m"), text.last_word(F.col("line")).alias("w"), last.alias("v")).collect()
    assert all(r.n == r.m and r.w == r.v for r in got)


def one_by_one(words, most):
    """Merges one after another, all pairs counted anew each time."""
    words, done = [(list(w), n) for w, n in words], []
    while len(done) < most:
        pairs = Counter()
        for t, n in words:
            for p in zip(t, t[1:]):
                pairs[p] += n
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        done.append((a, b))
        words = [(tokenizers._joined(t, a, b), n) for t, n in words]
    return done


@pytest.mark.parametrize("ahead, keep, tokens", [(64, 64, 100_000), (5, 3, 40), (1, 1, 1)])
def test_bpe_merges_are_those_made_one_by_one(spark, monkeypatch, ahead, keep, tokens):
    monkeypatch.setattr(merges, "TOKENS", tokens)
    r = random.Random(tokens)
    words = {"".join(r.choice("aab" if i % 2 else "aabcdeé") for _ in range(r.randint(1, 12))): r.randint(1, 60) for i in range(150)}
    words |= {"aaaa": 50, "aaa": 41, "abababab": 40, "abcabc": 33, "a" * 301: 2, "\n": 900, " ": 2000}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = one_by_one(words.items(), 60 if ahead > 1 else 25)
    assert merges.learn(df, sorted({c for w in words for c in w}), len(want), ahead, keep) == want
    assert merges.learn(df.limit(0), ["a"], 5) == [] and merges.learn(df.where("length(word) = 1"), sorted({c for w in words for c in w}), 5) == []
    few = df.where("word in ('aaaa', 'aaa')")
    assert merges.learn(few, ["a"], 99) == one_by_one([("aaaa", 50), ("aaa", 41)], 99)  # until no pair is left


def test_follow_puts_early_guesses_off():
    words = [("abx", 10), ("cdy", 9), ("cd", 2), ("efab", 3)]
    count = lambda ws: Counter(p for t, n in ws for q in zip(t, t[1:]) for p in [q] * n)
    now, steps, guessed = [(list(w), n) for w, n in words], [], [("c", "d"), ("a", "b"), ("e", "f")]
    for a, b in guessed:
        before = count(now)
        now = [(tokenizers._joined(t, a, b), n) for t, n in now]
        steps.append(merges.Step({p: count(now)[p] - before[p] for p in set(before) | set(count(now))}, before[a, b]))
    start = dict(count([(list(w), n) for w, n in words]))
    assert merges.follow(start, guessed, steps, 1) == ([("a", "b")], dict(count([(["ab", "x"], 10), (list("cdy"), 9), (list("cd"), 2), (["e", "f", "ab"], 3)])))
    done, left = merges.follow(start, guessed, steps, 9)
    assert done == [("a", "b"), ("c", "d")] and left["ab", "x"] == 10  # the next, (ab, x), wasn't guessed


def test_bpe_queries_take_documents(spark, tmp_path):
    body = "low lower lowest aaaa aaa banana bandana new newer newest ab abc abab " * 3
    d = spark.createDataFrame([(1, body), (2, "wider 42 @home"), (3, "low aab é"), (4, None), (5, "")], "doc_id long, text string")
    here = tokenizers.bpe_train(d, 12)
    assert here[0] == one_by_one([(r.word, r.n) for r in tokenizers.word_counts(d).collect()], 12)
    d = d.where("text is not null")
    odd = spark.createDataFrame([(1, "low"), (1, "new low"), (2, None), (3, ""), (None, "low")], "doc_id long, text string")
    names = {i: t for t, i in here[1].items()}
    got = [(r.doc_id, None if r.tokens is None else "".join(names[i] for i in r.tokens)) for r in tokenizers.bpe_encode(odd, *here).collect()]
    assert sorted(got, key=str) == sorted(map(tuple, odd.collect()), key=str)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "low")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    done, vocab = tokenizers.bpe_train(d)
    assert queries.QUERIES["bpe_train"](spark, str(tmp_path)).count() == len(done) > 12
    names = {i: t for t, i in vocab.items()}
    for r in queries.QUERIES["bpe_encode"](spark, str(tmp_path)).join(d, "doc_id").collect():
        assert "".join(names[i] for i in r.tokens) == r.text


def test_bpe_words_of_a_batch_are_those_one_by_one():
    r = random.Random(3)
    words = [" ", "\n", "a", "é?", "aaaaa", "abcab" * 30] + ["".join(r.choice("aabcd?") for _ in range(r.randint(1, 14))) for _ in range(400)]
    pairs = one_by_one(Counter(words).items(), 30) + [("b", "c"), ("a", "b"), ("a", "bc"), ("ab", "c"), ("abc", "a")]  # strings that two merges make
    pairs = list(dict.fromkeys(pairs))
    vocab = {c: i + 1 for i, c in enumerate("abcd \n")}
    for a, b in pairs:
        vocab[a + b] = len(vocab) + 1
    bpe = tokenizers.Bpe([p for p in pairs if "?" not in p[0] + p[1] and "é" not in p[0] + p[1]], vocab)
    assert bpe._steps is not None and bpe._steps[2]
    assert bpe.words(words) == [bpe.word(w) for w in words]
    late = tokenizers.Bpe([("ab", "c"), ("a", "b")], vocab)
    assert late._steps is None and late.words(["abc", "ab"]) == [late.word("abc"), late.word("ab")]


@pytest.mark.parametrize("name", ["lexicon_line_syllables", "lexicon_line_suffixes"])
def test_words_meet_the_corpus_lexicon_unsorted(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_bpe_guesses_follow_the_words(spark, monkeypatch):
    r = random.Random(8)
    parts = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    words = Counter("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(3000))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    passes, follow = [], merges.follow
    monkeypatch.setattr(merges, "follow", lambda *a: passes.append(follow(*a)) or passes[-1])
    assert merges.learn(df, list("abcdefgh"), 60) == one_by_one(words.items(), 60)
    assert len(passes) <= 6


def test_augmentation_keeps_lines(spark):
    d = spark.createDataFrame([(i, "s", "\n".join(f"the line {i} {j} of it" for j in range(20))) for i in range(3)], "doc_id long, source string, text string")
    text_of = {r.doc_id: r.text for r in d.collect()}
    for r in augment.shuffled_blocks(d, "doc_id").collect():
        old, new = text_of[r.doc_id].split("\n"), r.text.split("\n")
        assert all(sorted(old[i : i + 4]) == sorted(new[i : i + 4]) for i in range(0, 20, 4))
    r = augment.recombined(d, "source", "doc_id").first()
    assert len(r.text.split("\n")) == 16 and len({x.split()[2] for x in r.text.split("\n")}) == 2
    single = d.where("doc_id = 1").withColumn("source", F.lit("t"))
    assert len(set(augment.recombined(single, "source", "doc_id").first().text.split("\n"))) == 16  # two chunks of the one text
    short = spark.createDataFrame([(9, "u", "one line"), (10, "u", None), (11, "u", " ")], "doc_id long, source string, text string")
    big = augment.augmented(d.unionByName(short), multiplier=6).collect()
    n = Counter(r.pass_no for r in big)
    assert n[0] == 4 and 8 <= sum(n.values()) <= 24 and n[4] > 0 and len({r.text for r in big}) == len(big)
    assert {r.source for r in big if r.pass_no == 4} == {"s"}
    few = augment.augmented(short.unionByName(d.where("doc_id < 1").select("doc_id", F.lit("v").alias("source"), F.expr("substring_index(text, '\\n', 5)").alias("text"))), multiplier=4, table={"line": ["row"]}).collect()
    assert {r.pass_no for r in few} >= {0, 5} and not any(r.pass_no == 4 for r in few)  # nothing to recombine
    assert augment.swapped_synonyms(d, "doc_id", table={"line": ["x" * 150]}).where("text like '%" + "x" * 150 + "%'").count() == 3
    words = spark.createDataFrame([(i, f"w{i}") for i in range(120)], "rank long, word string")
    mixed = augment.interleaved(d.select("doc_id", "text"), words, "doc_id", 0.5).collect()
    assert sum(r.part == 0 for r in mixed) == 3 and sum(r.part == 1 for r in mixed) <= 3


def test_augmentation_writes_no_texts(spark):
    r = random.Random(7)
    line = lambda: "the " + " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5)) + ", of it and more of that"
    d = spark.createDataFrame([(i, "s", "\n".join(line() for _ in range(24))) for i in range(400)], "doc_id long, source string, text string")
    size = d.agg(F.sum(F.length("text"))).first()[0]
    where = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    on_disk = lambda: sum(x.stat().st_size for x in where.rglob("*") if x.is_file())
    before = on_disk()
    out = augment.augmented(d)
    assert Counter(x.pass_no for x in out.select("pass_no").collect()) == dict.fromkeys(range(4), 400)
    assert on_disk() - before < size / 3
    assert times(out, "regexp_extract_all") == [1]


def test_augmentation_of_repeated_rows(spark):
    long = lambda n: "\n".join(f"the line {n} {j} of it, and so it goes on" for j in range(16))
    rows = [(1, "s", long(1)), (1, "s", long(1)), (1, "s|1", long(1)), (1, None, long(1)), (None, "s", long(1)), (1, "s", long(2)), (1, "s", long(2)), (2, "t", long(1)), (None, None, "a"), (None, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = augment.augmented(d, multiplier=6).collect()
    texts = Counter(r.text for r in out)
    assert set(texts.values()) == {1} and {r.text for r in out if r.pass_no == 0} == {long(1), long(2), "a"}
    shuffled = {r.text for r in augment.shuffled_blocks(d, "doc_id", "source").collect()}
    swapped = {r.text for r in augment.swapped_synonyms(d, "doc_id", "source").collect()}
    assert {r.text for r in out if r.pass_no == 1} == shuffled and {r.text for r in out if r.pass_no == 2} == swapped
    assert {r.text for r in out if r.pass_no == 3} == {r.t for r in d.select(text.bar_split(F.col("text")).alias("t")).where("t is not null").collect()}
    chunks = {"\n".join(x.split("\n")[i : i + 8]) for x in (long(1), long(2)) for i in (0, 8)}
    mixed = augment.recombined(d, "source", "doc_id", d.select("source").distinct().crossJoin(spark.range(20).toDF("draw"))).collect()
    assert len(mixed) == 80 and {x for m in mixed for x in ("\n".join(m.text.split("\n")[:8]), "\n".join(m.text.split("\n")[8:]))} <= chunks


def test_ranges_stay_on_their_side_of_the_join(spark):
    d = spark.createDataFrame([(i, "s", "\n".join(f"{i} {j}" for j in range(20))) for i in range(40)], "doc_id long, source string, text string")
    out = numbered(augment.full_chunks(d, "source", "doc_id"), "source", "doc_id", "chunk", parts=4)
    assert sorted((r._no, r.doc_id, r.chunk, r._all) for r in out.collect()) == [(2 * i + c + 1, i, c, 80) for i in range(40) for c in range(2)]
    assert times(out, "aggregate([") == [2]  # for the rows and for the sizes of ranges, and in no filter


def test_near_copies_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    d = spark.createDataFrame([(1, base + "s\nsomething else entirely, not close"), (2, base.upper())], "doc_id long, text string")
    c = spark.createDataFrame([(1, base)], "item_id long, text string")
    got = {r.line: r.similarity for r in originality.near_copies(d, c).collect()}
    assert set(got) == {base, base + "s"} and got[base] == 1.0
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(4)) for _ in range(12)]
    probes, known = ([" ".join(r.choice(words) for _ in range(7)) for _ in range(n)] for n in (120, 60))
    probes += [k[:-1] + "z" for k in known[:30]] + ["aaaaaaaaaaaaaaaaaaaaa"]
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    d, c = (spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, text string") for ts in (probes, known))
    for similar in (0.3, 0.85):
        want = {(p, k) for p in probes for k in known if len(grams(p) & grams(k)) > similar * len(grams(p) | grams(k))}
        assert want and {(x.line, x.known_line) for x in originality.near_copies(d, c, similar).collect()} == want
    every = probes + known[:5] + known[:5] + ["a copy of a line"] * 40 + [None, None, "", "", "abcd", "abcd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "id long, text string")
    first = {t: i for i, t in reversed(list(enumerate(every))) if t and len(t) >= 5}
    sets = {i: grams(t) for t, i in first.items()}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) > 0.3 * len(sets[i] | sets[j])}
    want |= {(first[t], i) for i, t in enumerate(every) if t in first and i > first[t]}
    got = [(x.a, x.b) for x in retrieval.gram_overlap_pairs(rows, 0.3).collect()]
    assert set(got) == want and len(got) == len(want)  # 40 copies: 39 rows


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)], i % 2) for i in range(4)], "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(9, [1.0, 0.5, 0.25, 0.0])], "query_id long, query array<double>")
    assert [r.vec_id for r in retrieval.search(v, q, 2).orderBy("rank").collect()] == [0, 1]
    assert [r.vec_id for r in retrieval.search(v, q, 2, F.col("label") == 1).orderBy("rank").collect()] == [1, 3]
    assert [r.vec_id for r in retrieval.search(v, q, 1, F.col("label") == 1, "overfetch", 1).collect()] == []
    f = spark.createDataFrame([(1, 1, 0.9, "aaaaaa bbbbbb"), (1, 2, 0.8, "aaaaaa bbbbbb"), (1, 3, 0.7, "zzzzzz yyyyyy")], "query_id long, vec_id long, score double, text string")
    assert [r.vec_id for r in retrieval.diverse(f, 5).orderBy("rank").collect()] == [1, 3]


def test_retrieval_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float((i * p) % 11) for p in (3, 5, 7)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("ql"))
    same = F.col("label") == F.col("ql")
    ways = ({}, {"keep": ~same}, {"keep": ~same, "mode": "overfetch"}, {"prefer": same})
    rows = lambda: [sorted((r.query_id, r.rank, r.vec_id, r.score) for r in retrieval.search(v, q, 4, **w).collect()) for w in ways]
    whole = rows()
    monkeypatch.setattr(retrieval, "QUERIES", 25)
    assert rows() == whole


def test_search_of_copies_and_odd_vectors(spark, monkeypatch):
    """Products of matrices pick, the sums of ``dot`` decide: the rows and scores of a join of all pairs, without a row a pair."""
    from strophe.operators import nearest

    monkeypatch.setattr(nearest, "ROWS", 50)
    monkeypatch.setattr(nearest, "SCORES", 300)
    r = random.Random(5)
    some = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, some[i % 40] if i % 3 else some[0], i % 4 if i % 7 else None) for i in range(300)]
    rows += [(None, some[1], 1), (7, some[1], 1), (400, None, 1), (401, [1.0], 2), (402, [], 1), (403, [math.nan] * 16, 1), (404, [None] + some[2][1:], 2), (405, [math.inf] * 16, 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    q = v.where("vec_id % 10 = 0 or vec_id > 400").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("ql"))
    same = F.col("label") == F.col("ql")
    ways = ({}, {"keep": ~same}, {"keep": ~same, "mode": "overfetch"}, {"prefer": same}, {"keep": same, "least": 0.3}, {"keep": F.col("vec_id") != F.col("query_id")})
    rows_of = lambda df: sorted((str(x.query_id), x["rank"], str(x.vec_id), str(x.score), str(x.label), str(x.ql)) for x in df.collect())
    fine = lambda df, c: df.where(retrieval.fine(c, 16))
    got = [rows_of(retrieval.search(v, q, 4, **w)) for w in ways]
    assert "NestedLoopJoin" not in retrieval.search(fine(v, "embedding"), fine(q, "query"), 4, prefer=same)._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieval, "_kinds", lambda *a: None)
    assert got == [rows_of(retrieval.search(v, q, 4, **w)) for w in ways]


def test_rhyme_groups_are_whole(spark, tmp_path):
    words = [a + b + "ation" for a in "bcdfghjklmnp" for b in "aeioubcdfg"]
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("rhyme_groups",):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r.word for r in got) == sorted(words) and {r.n_words for r in got} == {120}
    (row,) = queries.QUERIES["rhyming_words"](spark, str(tmp_path)).collect()
    assert row.words.split() == sorted(words)[:100] and row.n_words == 120


def test_song_links(spark):
    html = '<a class="x" href="/lyric/1">One <b>song</b></a><a href="/lyric/2">17</a><a href="/about">About</a><a href="https://www.lyrics.com/lyric/3">Three</a><a href="https://genius.com/a-lyrics">Song A</a><a href="https://genius.com/a-lyrics">Again</a><a href="https://genius.com/b-lyrics">ab</a><a href="../lyrics/q/z.html">Z</a><a href="https://www.songlyrics.com/me/a-lyrics/">A</a><a href="https://www.songlyrics.com/me-lyrics/">me</a>'
    got = lambda site, **more: [tuple(x) for x in one(spark, text.song_links(F.col("t"), **text.LINK_RULES[site], **more), t=html)]
    assert got("lyrics.com") == [("One song", "https://www.lyrics.com/lyric/1"), ("Three", "https://www.lyrics.com/lyric/3")]
    assert got("azlyrics.com") == [("Z", "https://www.azlyrics.com../lyrics/q/z.html")]
    assert got("songlyrics.com", slug=F.lit("me"), page=F.lit("https://www.songlyrics.com/me-lyrics/")) == [("A", "https://www.songlyrics.com/me/a-lyrics/")]
    assert got("genius.com") == [("Song A", "https://genius.com/a-lyrics")]


def test_rhyme_bias_and_open_lines(spark):
    steps = [(1, "the ring\nlet them sing\nit was a long spring"), (2, "the ring\nlet it"), (3, "the ring\nlet it be now for a plan"), (4, "first line of four words"), (5, "a\nb\nc\nd\ntoo many lines for it ring")]
    ends = spark.createDataFrame([("ing", 10), ("ing", 11), ("an", 12), (None, 0)], "suffix string, token int")
    got = sequences.rhyme_bias(spark.createDataFrame(steps, "step long, text string"), [0, 0, 0, 1], ends).collect()
    assert sorted((r.step, r.token, round(r.bias, 6)) for r in got) == [(1, 0, 2.4), (3, 10, 1.5), (3, 11, 1.5)]


def test_reports(spark):
    profile = dict(dominant_scheme="AABB", scheme_confidence_named=0.125, avg_syllables=10.5, syllable_stddev=3.57, rhyme_density=0.144, contraction_rate=0.03, signature_words=["alpha", "beta"])
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in profile.items())
    df = spark.createDataFrame([tuple(profile.values()), (None,) * len(profile)], names)
    cards = [r.x for r in df.select(reports.profile_card(F.lit("Me")).alias("x")).collect()]
    assert "- **Bar length:** 10.5 syllables (±3.6)\n" in cards[0] and "(12% of clean patterns)" in cards[0] and cards[0].endswith("`alpha`, `beta`\n")
    assert cards[1] == "_No style profile available for Me_"
    got = [r.x for r in df.select(reports.prompt(F.lit("home"), F.lit("Me"), F.array(F.lit(" a\n\nb\nc ")), cap=2).alias("x")).collect()]
    assert got[0].split("\n") == ["Me writes in AABB couplets (lines 1+2 rhyme, 3+4 rhyme).", "Average bar length: 10 syllables.", "Me's signature vocabulary includes: alpha, beta.", "", "Rap verses by Me:", "", "Verse 1:", "a", "b", "", "Verse 2 by Me (AABB rhyme scheme) about home:"]
    assert got[1].split("\n") == ["Rap verses by Me:", "", "Verse 1:", "a", "b", "", "Verse 2 — home:"]
    assert reports.header_row(["loss"], True) == f"{'Model':<25} {'Params':>10} | {'loss':<16}"


def test_lookups_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([("Dave", "x" * 60 + f"\nline {i} of it\n" + "y" * 60, i) for i in (3, 1, 2)] + [("dave", "short", 9)], "artist string, text string, pos long")
    got = corpora.songs_of(d, "DAVE", "pos").collect()
    assert sorted((r.title, r.lyrics.split("\n")[1]) for r in got) == [(f"Track {i}", f"line {i} of it") for i in (1, 2, 3)]
    asked = []
    fetch = lambda a: (asked.append(a), corpora.songs_of(d, a, "pos"))[1]
    assert [corpora.cached_songs(spark, "Dave!", str(tmp_path), lambda a: fetch("dave")).count() for _ in range(2)] == [3, 3] and asked == ["dave"]
    assert corpora.cached_songs(spark, "nobody", str(tmp_path), fetch).count() == 0
    runs.write_results(d.groupBy("artist").count(), d, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "runs")).count() == 4
    p = spark.createDataFrame([("Nas", 1), ("NAS", 2)], "artist string, n int")
    assert corpora.profile_of(p, "NAS").first().n == 2 and corpora.profile_of(p, "nas").count() == 1
    (tmp_path / "syn.json").write_text('{"word": "Line", "replacements": ["row"]}\n{"word": "none", "replacements": []}\n')
    assert corpora.read_synonyms(spark, str(tmp_path / "syn.json")) == {"line": ["row"]}


def test_lexicon_paths(spark):
    lex = spark.createDataFrame([("money", 0, ["M", "AH1", "N", "IY0"]), ("honey", 0, ["HH", "AH1", "N", "IY0"]), ("honey", 1, ["X"]), ("ride", 0, ["R", "AY1", "D"])], "word string, variant int, phones array<string>")
    body = "all the money!\nmilk and honey\nwe ride\nunknownword"
    d = spark.createDataFrame([("s", 1, body + " " * 50)], "source string, doc_id long, text string")
    assert lines.suffix_docs(d, lex).first().suffixes == ["IY0", "IY0", "AY1 D", None]
    rows = lines.line_table(d, text.style_lines(F.col("text")), "doc_id")
    assert [r.syllables for r in lines.syllables_of_lines(rows, lex, "doc_id").orderBy("line_no").collect()] == [1 + 1 + 2, 1 + 1 + 2, 2, 3]
    assert [r.scheme for r in lines.scheme_windows(d, lexicon=lex).collect()] == ["unknown"]


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("a", 'line "one"\nline two'), ("b", None)], "artist string, artist_verses string")
    corpora.write_lyrics(d, str(tmp_path / "csv"))
    assert [tuple(r) for r in corpora.read_lyrics(spark, str(tmp_path / "csv")).collect()] == [("a", 'line "one"\nline two')]
    (tmp_path / "cmu.txt").write_text(";;; c\nMONEY  M AH1 N IY0\nMONEY(1)  M AH1 N IY1\nZ  Z IY1 # x\n")
    lex = corpora.read_lexicon(spark, str(tmp_path / "cmu.txt"))
    assert sorted((r.word, r.variant, len(r.phones)) for r in lex.collect()) == [("money", 0, 4), ("money", 1, 4), ("z", 0, 2)]
    english = spark.createDataFrame([("money",), ("abc",), ("a",)], "word string")
    assert sorted(r.word for r in corpora.dictionary(lex, english).collect()) == ["abc", "money"]
    rows = spark.createDataFrame([("r", 1, 0.1, "loss", 2.0), ("r", 2, 0.2, "loss", 1.0)], runs.METRIC)
    runs.append(rows, str(tmp_path / "log"))
    assert runs.last_metrics(runs.read_metrics(spark, str(tmp_path / "log"))).first().last_value == 1.0
    assert runs.read_metrics(spark, str(tmp_path / "none")).count() == 0
    corpora.write_tokenizer(spark, [("a", "b")], {"a": 0, "b": 1, "ab": 2}, str(tmp_path / "tok"))
    assert corpora.read_tokenizer(spark, str(tmp_path / "tok")) == ([("a", "b")], {"a": 0, "b": 1, "ab": 2})
    c = Config()
    c.chunks.size = 4
    c.save(str(tmp_path / "c.yaml"))
    assert Config.load(str(tmp_path / "c.yaml")) == c


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 120).alias("ts"), (F.col("id") % 3).cast("string").alias("m"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed(read_stream(spark, str(tmp_path / "in"), rows.schema, "parquet"), "ts", "m")
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = {tuple(r) for r in windowed(rows, "ts", "m").collect()}
    assert got and got <= every and len(every) - len(got) <= 6  # windows still open when the input ends


def test_labels_of_any_windows(spark):
    body = "one two three\n\n  \nfour five sixty\nseven eight\nlast"
    d = spark.createDataFrame([(1, body), (2, "no end"), (3, ""), (4, None), (None, "ab\ncd\n")], "id int, text string")
    starts = [(1, 0), (1, 0), (1, 4), (1, 8), (1, 13), (1, 20), (1, 99), (2, 0), (None, -1), (None, 0)]
    windows = spark.createDataFrame(starts, "id int, start int")
    for block in (3, 16, 64):
        got = sequences.window_labels(sequences.line_ends(d, "id"), windows, block, "id").collect()
        want = []
        for i, s in starts:
            now = ""
            for t, c in enumerate({r.id: r.text for r in d.collect()}[i][s + 1 : s + 1 + block]):
                if c == "\n":
                    if now.split():
                        want.append((i, s, t, one(spark, phonetics.spelled_suffix(F.col("w")), w=now.split()[-1]), one(spark, phonetics.syllable_bucket(phonetics.line_syllables(F.col("w"))), w=now)))
                    now = ""
                else:
                    now += c
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and (want or block == 3)


def test_recent_tokens_by_runs(spark):
    r = random.Random(2)
    texts = {1: [r.choice("abcdefgh") for _ in range(120)], 2: ["a"], 3: [None, "b", None], 4: list("ab" * 30)}
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    d = spark.createDataFrame(rows, "id int, pos int, token string").repartition(3)
    for n in (1, 4, 50):
        spans = sequences.recent_spans(d, "id", n)
        sets = {(k, p): set(ts[max(0, p - n) : p]) for k, ts in texts.items() for p in range(len(ts))}
        runs = spans.collect()
        assert {(k, p): {s.token for s in runs if s.id == k and s.first <= p <= s.last} for k, p in sets} == sets
        got = {(x.id, x.pos): (x.n_recent, x.recent) for x in sequences.recent_counts(d, spans, "id").collect()}
        assert got == {(k, p): (len(v), texts[k][p] in v) for (k, p), v in sets.items()}
    assert sequences.recent_counts(d.limit(0), sequences.recent_spans(d.limit(0), "id"), "id").count() == 0


def test_recent_summaries_shuffle_nothing(spark):
    r = random.Random(3)
    texts = [[r.choice("abcdefgh") for _ in range(150)], ["a"], [None, "b", None], list("ab" * 30), []]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>").where(F.size("tokens") > 0)
    rows = d.select("id", F.posexplode("tokens").alias("pos", "token"))
    for n in (1, 4, 50):
        spans = sequences.recent_spans(rows, "id", n)
        at = {x.id: x for x in sequences.recent_counts(rows, spans, "id").groupBy("id").agg(F.count("*").alias("n"), F.count_if("recent").alias("p"), F.max("n_recent").alias("m")).collect()}
        runs = {x.id: x for x in spans.groupBy("id").agg(F.count("*").alias("s"), F.sum(F.col("last") - F.col("first") + 1).alias("c")).collect()}
        found = sequences.recent_summaries(d, "tokens", n)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {x.id: tuple(x)[2:] for x in found.collect()} == {k: (at[k].n, at[k].p, runs[k].s, runs[k].c, at[k].m) for k in at}


def test_walk_of_open_words(spark):
    steps = tokenizers.transitions(spark.createDataFrame([("an",), ("ant",), ("at",), ("an",), ("é",), (None,), ("",)], "word string"))
    assert steps.count() == 5
    words = spark.createDataFrame(list(enumerate(["", "a", "an", "ant", "ants", "b", "é", "ab", None, "an"])), "id int, word string")
    got = {r.id: (r.depth, r.alive, r.is_word, r.next_chars) for r in tokenizers.walk(words, steps, "id").collect()}
    live = {0: (0, True, False, "aé"), 1: (1, True, False, "nt"), 2: (2, True, True, "t"), 3: (3, True, True, ""), 6: (1, True, True, ""), 9: (2, True, True, "t")}
    dead = {4: 3, 5: 0, 7: 1, 8: 0}
    assert got == live | {k: (n, False, False, "") for k, n in dead.items()}
    most = tokenizers.completion_tokens(spark.createDataFrame([("x", "b", [1, 9]), ("x", "a", [3]), ("x", "c", [7]), (None, "d", [1]), ("x", "0", []), ("y", "z", [9, 9])], "suffix string, word string, tokens array<int>"), 2)
    assert {(r.suffix, r.n_words, tuple(r.tokens)) for r in most.collect()} == {("x", 2, (3, 9)), ("y", 1, (9,))}


def test_boundary_marks(spark):
    for t in ("", "a b", "\n\t ", "naïve 😀\r\nx\u2028y\u00a0z", "\x00 1 0", None):
        want = None if t is None else "".join("1" if c in " \n\t" else "0" for c in t)
        d = spark.createDataFrame([(t,)], "t string")
        assert d.select(sequences.boundary_marks(F.col("t")), F.array_join(sequences.boundary_labels(F.col("t")), "")).first() == (want, want)


def test_profiles_cut_texts_once(spark, tmp_path):
    """Each text is read and cut in one job that writes; what the result still reads is made of that."""
    r = random.Random(1)
    texts = [(i, "ab"[i % 2], "\n".join(" ".join(r.choice(["cat", "hat", "code", "rode", "42", "sky"]) for _ in range(4)) for _ in range(r.randrange(9)))) for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/texts")
    d = spark.read.parquet(f"{tmp_path}/texts")
    for got in (profiles.style_profiles(d), profiles.scheme_profile(d), lines.adjacent_pairs(d), profiles.signature_words(d)):
        assert f"{tmp_path}/texts" not in got._jdf.queryExecution().toString() and got.count() >= 0
    arrays = [[r.choice(["x", "y", None]) for _ in range(n)] for n in range(12)]
    got = lines.pairs_of(spark.createDataFrame([(str(i), a) for i, a in enumerate(arrays)], "source string, s array<string>")).collect()
    for x in got:
        a = arrays[int(x.source)]
        pairs = [(a[i + k], a[i + k + 1]) for i in range(len(a) - 3) for k in range(3)]
        assert (x.pairs, x.rhymes) == (sum(None not in p for p in pairs), sum(p[0] is not None and p[0] == p[1] for p in pairs))


def test_mixed_draws(spark):
    steps = spark.createDataFrame([(i,) for i in range(3000)] + [(None,), (7,)], "step int")
    a, b = spark.createDataFrame([(10 * i,) for i in range(5)] + [(None,)], "a long"), spark.createDataFrame([(i,) for i in range(100, 140)], "b int")
    got = sequences.mixed_draws(steps, "step", a, "a", b, "b", 0.25).collect()
    assert len(got) == 3002 and sum(r.step == 7 for r in got) == 2
    mine, other = Counter(r.row for r in got if r.from_first), Counter(r.row for r in got if not r.from_first)
    assert set(mine) == {0, 10, 20, 30, 40} and set(other) == set(range(100, 140)) and abs(sum(mine.values()) / 3002 - 0.25) < 0.03
    assert max(mine.values()) < 1.4 * min(mine.values())
    again = sequences.mixed_draws(steps.repartition(7), "step", a.repartition(3), "a", b.repartition(2), "b", 0.25).collect()
    assert Counter(got) == Counter(again)
    assert {r.from_first for r in sequences.mixed_draws(steps, "step", a.limit(0), "a", b, "b", 0.9).collect()} == {False}
    assert {r.from_first for r in sequences.mixed_draws(steps, "step", a, "a", b.limit(0), "b", 0.0).collect()} == {True}
    assert sequences.mixed_draws(steps, "step", a.limit(0), "a", b.limit(0), "b", 0.5).count() == 0


def test_temperature_sweep(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [5.0, 5.0, 5.0]), ("b", [0.0, 800.0, -800.0]), (None, [1.0, 1.0]), ("c", None), ("c", [])], "k string, x array<double>")
    got = {(r.temperature, r.level, r.of_all): r for r in sequences.temperature_sweep(rows, F.col("x"), [0.5, 2.0], "k").collect()}

    def both(x, t):
        e = [math.exp((v - max(x)) / t) for v in x]
        p = [v / sum(e) for v in e]
        return -sum(v * math.log(v) for v in p if v), max(p)

    assert len(got) == 2 * 3 + 2 + 1 and got[None, None, 3].n == 8 and got[0.5, None, 1].n == 4 and got[0.5, None, 0].n == 1
    want = [both([1.0, 2.0, 3.0], 2.0), both([5.0] * 3, 2.0)]
    assert got[2.0, "a", 0].mean_entropy == pytest.approx(sum(w[0] for w in want) / 2) and got[2.0, "a", 0].mean_top == pytest.approx(sum(w[1] for w in want) / 2)
    assert got[2.0, "a", 0].std_top == pytest.approx(abs(want[0][1] - want[1][1]) / 2) and got[0.5, "b", 0].mean_entropy == pytest.approx(0)


def test_continuations_take_time_in_proportion(spark):
    text = "".join(random.Random(1).choice("abcé ") for _ in range(400))
    d = spark.createDataFrame([(text,), (text[:25],), (text[5:40],), (None,), ("",)], "text string")
    want = {}
    for t in (text, text[5:40]):
        for i in range(len(t) - 25):
            want.setdefault(t[i : i + 25], set()).add(t[i + 25])
    assert {r.prefix: set(r.next_chars) for r in originality.continuations(d).collect()} == want


@pytest.mark.parametrize("pairs", [100_000, 60])
def test_indexed_search_is_exact_and_skips_clusters(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(vector_index, "PAIRS", pairs)
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in centres[i % 12]], i % 3) for i in range(600)]
    rows += [(700, rows[0][1], 1), (701, rows[0][1], 1), (702, None, 0), (703, [], 0), (704, [1.0], 0), (705, [math.nan] * 8, 0), (3, rows[3][1], rows[3][2])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    vector_index.write_index(v, f"{tmp_path}/i", clusters=24, by="label")
    clusters, held = spark.read.parquet(f"{tmp_path}/i/clusters"), vector_index.read_vectors(spark, f"{tmp_path}/i", v)
    fine = v.where("vec_id < 702")
    q = fine.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows_of = lambda df: sorted((x.query_id, x["rank"], x.vec_id, round(x.score, 5)) for x in df.collect())
    got, scored = vector_index.search_index(held, clusters, q, 5)
    assert rows_of(got) == rows_of(retrieval.search(fine, q, 5))
    assert sum(x.scored for x in scored.collect()) < 0.5 * q.count() * fine.count()  # most vectors are never scored
    got, _ = vector_index.search_index(held, clusters, q, 5, F.col("label") == 2)
    assert rows_of(got) == rows_of(retrieval.search(fine.where("label = 2"), q, 5))
    assert "PartitionFilters: [isnotnull(label" in held.where("label = 2")._jdf.queryExecution().toString()
    assert rows_of(vector_index.search_index(held, clusters, q.limit(0), 5)[0]) == []
    few = vector_index.search_index(held, clusters, q.limit(1), 1000)[0]
    assert few.count() == fine.count()


def test_gram_prefixes_order_substrings_where_the_text_is(spark):
    texts = spark.createDataFrame([("abcdefgh",), ("abcdefgx",), ("",), (None,), ("abcd",), ("\U0001F600bcdef",), ("zzzzzz",)], "line string").repartition(3)
    freq = originality.gram_counts(texts, "line")
    rows = originality.gram_prefixes(texts, "line", freq, 0.5)
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    sizes = {r.line: r.h for r in texts.select("line", F.xxhash64("line").alias("h")).collect()}
    got = {}
    for r in rows.collect():
        got.setdefault(r.h, []).append((r["size"], r.gram))
    assert {k: (got[h][0][0], len(set(got[h]))) for k, h in sizes.items() if h in got} == {"abcdefgh": (4, 3), "abcdefgx": (4, 3), "\U0001F600bcdef": (2, 2), "zzzzzz": (1, 1)}
    assert freq.agg(F.sum("freq")).first()[0] == 11
