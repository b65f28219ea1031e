"""Queries of corpus building: datasets, lookups, splits, retrieval with fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lines as L
from ..operators import retrieval, sequences
from ..sources import corpora
from . import sql as Q
from .queries import FOUND, RANKED, artist_vocab, docs, found, query, table, vector_queries


@query(f"""WITH d AS (SELECT doc_id, source, array_to_string({Q.page("coalesce(text, '')")}, chr(10)) AS lyrics FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lyrics ORDER BY doc_id) AS r FROM d)
SELECT doc_id, source, lyrics FROM r WHERE r = 1 AND length(lyrics) > 100""")
def build_dataset(spark, sf):
    return corpora.built_dataset(docs(spark, sf).select("doc_id", "source", F.col("text").alias("lyrics")), "doc_id", "source")


@query(f"""WITH d AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lower(source) = 'src1' AND length(text) > 100)
SELECT 'SRC1' AS artist, 'Track ' || r AS title, array_to_string({Q.page("text")}, chr(10)) AS lyrics FROM d""")
def artist_tracks(spark, sf):
    return corpora.songs_of(docs(spark, sf).select(F.col("source").alias("artist"), "text", "doc_id"), "SRC1", "doc_id")


@query("""WITH n AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part_no, count(*) OVER (PARTITION BY source) AS m FROM documents)
SELECT source, part_no, md5(text || CASE WHEN part_no < m THEN chr(10) || chr(10) ELSE '' END) AS part_md5 FROM n""")
def training_corpus(spark, sf):
    return corpora.training_corpus(docs(spark, sf), "source", "doc_id").select("source", "part_no", F.md5("text").alias("part_md5"))


@query("SELECT doc_id, title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents WHERE text IS NOT NULL) WHERE NOT regexp_matches(title, 'Remix|Live|Demo|Skit')")
def titles_without_versions(spark, sf):
    titles = docs(spark, sf).where("text is not null").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return corpora.without_versions(titles)


@query(f"SELECT doc_id, array_to_string(list_filter({Q.split('text')}, lambda z: {Q.strip('z')} <> '')[1:3], chr(10)) AS head, regexp_replace(regexp_replace(lower({Q.strip('source')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def first_lines_and_slugs(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(text.first_lines(F.col("text"), 3), "\n").alias("head"), text.slug(F.col("source")).alias("slug"))


@query(f"SELECT doc_id, source, {Q.keyed(0, 'doc_id')} % 1000000 / 1000000.0::DOUBLE < 0.1 AS is_val FROM documents")
def hash_split(spark, sf):
    return sequences.split_by_hash(docs(spark, sf).select("doc_id", "source"), "doc_id", 0.1)


@query("""WITH v AS (SELECT source, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT c.conv_id, c.turn, c.role, coalesce(v.id, 0) AS id FROM conversations c LEFT JOIN v ON v.source = 'src' || (c.conv_id % 30)""")
def verse_artist_ids(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("src"), (F.col("conv_id") % 30).cast("string")).alias("artist"))
    return L.with_vocabulary_ids(rows, "artist", artist_vocab(spark, sf)).select("conv_id", "turn", "role", "id")


@query(FOUND + f"""r AS (SELECT *, {RANKED} AS rank FROM p WHERE label = ql AND score > 0.3), f AS (SELECT * FROM r WHERE rank <= 5), s AS (SELECT *, {RANKED} AS rank FROM p),
u AS (SELECT query_id, rank, vec_id, score FROM f UNION ALL SELECT query_id, rank, vec_id, score FROM s WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM f)),
b AS (SELECT u.*, sum(length(text) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM u JOIN documents ON doc_id = vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM b WHERE used <= 4000""")
def retrieve_within_budget(spark, sf):
    """The best of the query's own label that are near it, else the best of all; as many as fit 4,000 characters."""
    v, q = vector_queries(spark, sf)
    first = retrieval.search(v, q, 5, F.col("label") == F.col("ql"), least=0.3)
    texts = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    return found(retrieval.within_budget(retrieval.with_fallback(first, retrieval.search(v, q, 5), q).join(texts, "vec_id"), 4000))


@query("""WITH d AS (SELECT item_id, text, min(item_id) OVER (PARTITION BY text) AS first FROM benchmark WHERE length(text) >= 5),
g AS (SELECT item_id, list_distinct(list_transform(range(1, length(text) - 3), lambda g0: substr(text, g0, 5))) AS g FROM d WHERE item_id = first), x AS (SELECT item_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.item_id AS a, b.item_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.x = b.x AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS overlap FROM p WHERE i::DOUBLE / (na + nb - i) > 0.03
UNION ALL SELECT first, item_id, 1.0::DOUBLE FROM d WHERE item_id > first""")
def benchmark_overlap_pairs(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.gram_overlap_pairs(rows, 0.03).withColumn("overlap", F.round("overlap", 6))


_ANCHORS = "regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', {})"


@query(f"""WITH a AS (SELECT page_id, unnest({_ANCHORS.format(1)}) AS link, unnest({_ANCHORS.format(2)}) AS body FROM pages), t AS (SELECT page_id, link, {Q.strip("regexp_replace(body, '<[^>]+>', '', 'g')")} AS title FROM a)
SELECT page_id, title, 'https://site' || link AS link FROM t WHERE (starts_with(link, '/t') OR starts_with(link, '/d')) AND length(title) >= 2 AND NOT regexp_matches(title, '^[0-9]+$')""")
def song_links(spark, sf):
    """A site's rule on the given pages: links below /t or /d."""
    got = text.song_links(F.col("html"), starts=("/t", "/d"), least=2, digits=False, base="https://site")
    return table(spark, sf, "pages").select("page_id", F.explode(got).alias("x")).select("page_id", "x.title", "x.link")
