"""The pipeline's stages on a small corpus, each against what it must keep."""

import pytest

from strophe.llm.ngram_join import ngram_join

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(100001, None, "en", "src0", 0), (100002, "12 !", "en", "src0", 4), (None, "The and is of to in a that for", "en", None, 10)], docs.schema)
    twice = docs.where("doc_id = 7")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id = 3").first().text
    leak = spark.createDataFrame([(100003, f"The of and to in is. {item}", "en", "src1", 10)], docs.schema)
    docs = docs.unionByName(odd).unionByName(twice).unionByName(leak)
    kept = [docs]
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, kept[-1], SF)
        assert out.columns == docs.columns, name
        kept.append(out.cache())
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert set(ids[0]) - set(ids[1]) == {100001, 100002}
    assert ids[2].count(7) == 2 and ids[3].count(7) == 1
    joined = {r.doc_id: r.component_id for r in ngram_join(kept[2]).collect()}
    assert set(ids[3]) == {i for i in ids[2] if joined[i] == i or i is None}
    assert 100003 in ids[3] and 100003 not in ids[4]
    last = pipeline.STAGES[-1][1](spark, kept[-1], SF)
    assert sorted(map(str, ids[4])) == sorted(str(r.doc_id) for r in last.collect())


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 100


def _pages(spark, pages):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(pages)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id: r.text for r in pipeline.line_stage(spark, docs, SF).collect()}


def _own(i):
    return "\n".join(f"own line {j} of page {i}" for j in range(12))


def test_line_stage_keeps_the_text_of_copies(spark):
    near = [_own("near").replace("own line 3", f"changed {i}") for i in range(20)]
    pages = [("s", _own(i)) for i in range(40)] + [("s", _own("copy"))] * 20 + [("s", t) for t in near]
    assert _pages(spark, pages) == {i: t for i, (_, t) in enumerate(pages)}


def test_line_stage_drops_lines_of_few_pages(spark):
    pages = [("s", f"{_own(i)}\nAll rights reserved." if i % 33 == 0 else _own(i)) for i in range(300)]
    got = _pages(spark, pages)
    assert got == {i: _own(i) for i in range(300)}


def test_line_stage_is_dataframe_operations_only(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def python(*_, **__):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(DataFrame, "mapInArrow", python)
    monkeypatch.setattr(DataFrame, "mapInPandas", python)
    near = [_own("near").replace("own line 3", f"changed {i}") for i in range(20)]
    pages = [("s", _own(i)) for i in range(40)] + [("s", t) for t in near]
    assert _pages(spark, pages) == {i: t for i, (_, t) in enumerate(pages)}


def test_near_copies_in_dataframe_functions(spark):
    from strophe.llm.copies import near_copies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(100001, None), (100002, " \n"), (100003, "One two"), (100004, "one  TWO"), (100005, "two one")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    found = {r.id: r.group for r in near_copies(docs, "doc_id", "text").collect()}
    exact = {r.doc_id: r.component_id for r in ngram_join(docs).collect() if r.n_shingles}
    assert found.keys() == exact.keys()
    for a, b in ((found, exact), (exact, found)):
        assert len({(a[i], b[i]) for i in a}) == len(set(a.values()))


def test_near_copies_sends_whole_sets_only_where_heads_allow(spark, monkeypatch):
    import random

    from strophe.llm import copies

    rng = random.Random(5)
    shared = [" ".join(f"s{k}_{i}" for i in range(12)) for k in range(3)]
    texts = []
    for i in range(60):  # pages that share a passage, and near copies of every likeness
        own = [f"w{rng.randrange(10**6)}" for _ in range(40 + i)]
        texts.append(f"{shared[i % 3]} {' '.join(own)}")
        if i % 4 == 0:
            for cut in (1, 2, 4, 8):
                texts.append(f"{shared[i % 3]} {' '.join([f'x{cut}'] * cut + own[cut:])}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, stash = {}, copies.stash
    monkeypatch.setattr(copies, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    monkeypatch.setattr(copies, "discard", lambda *frames: None)
    found = {r.id: r.group for r in copies.near_copies(docs, "doc_id", "text").collect()}
    sets = {r.node: set(r["items"]) for r in written["sets"].collect()}
    pairs = {tuple(r) for r in written["pairs"].collect()}
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    possible = {tuple(r) for r in written["possible"].collect()}
    assert alike and {tuple(r) for r in written["edges"].collect()} == alike <= possible
    assert len(possible) < len(pairs) / 2
    assert found == {r.id: r.group for r in copies.near_copies(docs, "doc_id", "text", small=0).collect()}
