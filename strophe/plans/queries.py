"""All queries of the library over the given tables, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..functions.scheme import NAMED
from ..operators import augment, originality, profiles, quality, retrieval, sequences, tokenizers, vector_index
from ..operators import lines as L
from ..operators.following import numbered, numbered_values
from ..sources import corpora, runs
from ..stash import shared_dir
from ..streaming.run_metrics import windowed
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# schemes and profiles

_NAMED = " + ".join(f'"{s}"' for s in NAMED)


@query(f"""WITH {Q.WINDOWS},
n AS (SELECT source, CAST(count(*) FILTER (scheme <> 'unknown') AS BIGINT) AS k, {", ".join(f"CAST(count(*) FILTER (scheme = '{s}') AS BIGINT) AS \"{s}\"" for s in NAMED)} FROM c GROUP BY source),
m AS (SELECT *, greatest("AABB", "ABAB", "ABBA", "AAAA") AS top, {_NAMED} AS named FROM n)
SELECT source, CASE WHEN top = 0 THEN 'free' {" ".join(f"WHEN \"{s}\" = top THEN '{s}'" for s in NAMED)} END AS dominant_scheme,
  CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE round(top::DOUBLE / k, 3) END AS scheme_confidence, CASE WHEN named = 0 THEN 0.0::DOUBLE ELSE round(top::DOUBLE / named, 3) END AS scheme_confidence_named,
  k AS scheme_window_count, CAST(named AS BIGINT) AS scheme_named_count FROM m""")
def scheme_profile_by_source(spark, sf):
    return profiles.scheme_profile(docs(spark, sf))


@query(f"""WITH {Q.WINDOWS}, n AS (SELECT source, scheme, count(*) AS n FROM c WHERE scheme <> 'unknown' GROUP BY source, scheme)
SELECT source, scheme, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 3) AS share FROM n""")
def scheme_distribution_by_source(spark, sf):
    return profiles.scheme_distribution(docs(spark, sf))


@query(f"""WITH {Q.WINDOWS}, p AS (SELECT source, CAST(sum((a IS NOT NULL AND b IS NOT NULL)::INT + (b IS NOT NULL AND c IS NOT NULL)::INT + (c IS NOT NULL AND d IS NOT NULL)::INT) AS BIGINT) AS pairs,
  CAST(sum(coalesce(a = b, false)::INT + coalesce(b = c, false)::INT + coalesce(c = d, false)::INT) AS BIGINT) AS rhymes FROM w GROUP BY source)
SELECT source, pairs, rhymes, CASE WHEN pairs = 0 THEN 0.0 ELSE round(rhymes::DOUBLE / pairs, 3) END AS rhyme_density FROM p""")
def adjacent_rhyme_density_by_source(spark, sf):
    return L.adjacent_pairs(docs(spark, sf)).withColumn("rhyme_density", F.coalesce(F.round(F.try_divide("rhymes", "pairs"), 3), F.lit(0.0)))


@query(f"""WITH {Q.LINES}, x AS (SELECT source, nullif({Q.syllables("line")}, 0) AS s, length(line) AS c, len({Q.words("line")}) AS w, len(regexp_extract_all(line, {Q.q(text.CONTRACTION)})) AS k FROM l)
SELECT source, count(*) AS total_lines, coalesce(round(avg(s), 1), 0.0) AS avg_syllables, coalesce(round(stddev_samp(s), 2), 0.0) AS syllable_stddev, round(avg(c), 1) AS avg_line_length_chars,
  coalesce(round(sum(k)::DOUBLE / nullif(sum(w), 0), 3), 0.0) AS contraction_rate FROM x GROUP BY source""")
def line_statistics_by_source(spark, sf):
    return profiles.line_statistics(docs(spark, sf))


@query(f"""WITH {Q.LINES}, x AS (SELECT {Q.syllables("line")} AS s FROM l)
SELECT CASE WHEN s <= 6 THEN 0 WHEN s <= 9 THEN 1 WHEN s <= 12 THEN 2 WHEN s <= 15 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM x GROUP BY 1""")
def syllable_buckets(spark, sf):
    rows = L.line_table(docs(spark, sf).where(F.length("text") >= 50), text.style_lines(F.col("text")))
    return rows.groupBy(phonetics.syllable_bucket(phonetics.line_syllables(F.col("line"))).alias("bucket")).agg(F.count("*").alias("n"))


_STOP = ", ".join(Q.q(w) for w in profiles.STOP)
_NEVER = ", ".join(Q.q(w) for w in profiles.NEVER)


@query(f"""WITH d AS (SELECT source, {Q.style("text")} AS ls FROM documents WHERE length(text) >= 50),
t AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(array_to_string(ls, ' ')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$'))) AS word FROM d),
tf AS (SELECT source, word, count(*) AS tf FROM t WHERE word NOT IN ({_STOP}) GROUP BY source, word),
a AS (SELECT count(DISTINCT source) AS n FROM d WHERE len(ls) > 0),
df AS (SELECT word, count(*) AS df, sum(tf) AS total FROM tf GROUP BY word HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT n FROM a) ORDER BY total DESC, word LIMIT 10000),
r AS (SELECT source, word, (1 + ln(tf)) * (ln((1 + (SELECT n FROM a)) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN df USING (word)),
n AS (SELECT source, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY source),
o AS (SELECT source, word, round(raw / norm, 6) AS score FROM r JOIN n USING (source) WHERE word NOT IN ({_NEVER}))
SELECT source, CAST(rank AS INTEGER) AS rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS rank FROM o) WHERE rank <= 30""")
def signature_words_by_source(spark, sf):
    return profiles.signature_words(docs(spark, sf))


# cleaning and dedup


@query(f"SELECT doc_id, array_to_string({Q.page('text')}, chr(10)) AS text FROM documents WHERE length(array_to_string({Q.page('text')}, chr(10))) > 100")
def clean_documents(spark, sf):
    return L.once(docs(spark, sf), text.clean_page(F.col("text")), "doc_id").where(F.length("text") > 100)


@query(f"""SELECT doc_id, array_to_string(list_filter({Q.lines("text")}, lambda z: NOT regexp_matches(z, {Q.q(text.HEADER)}) AND (length(z) >= 3 OR regexp_matches(z, '^\\p{{L}}'))), chr(10)) AS user_text,
  array_to_string(list_filter({Q.lines("text")}, lambda z: NOT regexp_matches(z, {Q.q(text.HEADER)}) AND NOT ({" OR ".join(f"contains(z, {Q.q(p)})" for p in text.WEB_NOISE)}) AND NOT regexp_matches(z, '^\\d+$') AND length(z) >= 3), chr(10)) AS web_text FROM documents""")
def clean_variants(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", text.clean_user_text(c).alias("user_text"), text.clean_web_text(c).alias("web_text"))


_SPAM = f"""d AS (SELECT doc_id, source, {Q.page("text")} AS ls FROM documents), k AS (SELECT * FROM d WHERE length(array_to_string(ls, chr(10))) > 100),
n AS (SELECT line, count(*) AS n FROM (SELECT unnest(ls) AS line FROM k) GROUP BY line HAVING count(*) >= 5)"""


@query(f"WITH {_SPAM} SELECT line, n FROM n")
def spam_lines(spark, sf):
    return L.spam_lines(docs(spark, sf))


@query(f"""WITH {_SPAM}, p AS (SELECT list(line) AS spam FROM n),
o AS (SELECT doc_id, source, array_to_string(list_filter(ls, lambda z: NOT coalesce(list_contains(spam, z), false)), chr(10)) AS text FROM k, p) SELECT * FROM o WHERE length(text) > 100""")
def docs_after_spam_removal(spark, sf):
    return L.without_spam(docs(spark, sf))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def doc_exact_dedup(spark, sf):
    return L.exact_dedup(docs(spark, sf)).select("doc_id", "source", "n_chars")


@query(f"WITH {Q.LINES} SELECT source, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, round(count(DISTINCT line)::DOUBLE / count(*), 4) AS ratio FROM l GROUP BY source")
def line_uniqueness(spark, sf):
    rows = L.line_table(docs(spark, sf).where(F.length("text") >= 50), text.style_lines(F.col("text")), "source").groupBy("source", F.xxhash64("line").alias("h")).agg(F.count("*").alias("n"))
    out = rows.groupBy("source").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_distinct"))
    return out.withColumn("ratio", F.round(F.try_divide(F.col("n_distinct"), F.col("n_lines")), 4))


@query("SELECT source, count(*) AS n_docs, count(*) FILTER (length(text) > 50) AS over_50, count(*) FILTER (length(text) > 100) AS over_100 FROM documents WHERE text IS NOT NULL GROUP BY source")
def source_counts(spark, sf):
    n = F.length("text")
    return docs(spark, sf).where("text is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum((n > 50).cast("long")).alias("over_50"), F.sum((n > 100).cast("long")).alias("over_100"))


@query("""WITH t AS (SELECT regexp_replace(lower(string_split(text, chr(10))[1]), '[^A-Za-z0-9_]', '', 'g') AS title_key, doc_id, source FROM documents WHERE length(text) > 100 AND source IS NOT NULL)
SELECT title_key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) AS r FROM t) WHERE r = 1""")
def titles_by_priority(spark, sf):
    """The first line stands for the title."""
    d = docs(spark, sf).select("source", F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("lyrics"))
    out = corpora.scraped_union([d.where("source = 'src0'"), d.where("source <> 'src0'")])
    return out.select(text.title_key(F.col("title")).alias("title_key"), F.col("pos").alias("doc_id"))


# chunks


@query(f"WITH {Q.chunks(Q.verse('text'), 16, 16, 8, 'doc_id')} SELECT doc_id, chunk_id, CAST(len(ls) AS INTEGER) AS n_lines, array_to_string(ls, chr(10)) AS verse FROM k")
def verse_chunks_tumbling(spark, sf):
    return L.verse_chunks(docs(spark, sf), "doc_id").select("doc_id", "chunk_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("verse"))


_INDEX = f"""{Q.chunks(Q.style("text"), 16, 8, 4, "source, doc_id", "length(text) >= 50")},
e AS (SELECT *, list_transform(ls[1:4], lambda y: {Q.suffix(Q.end_word("y"))}) AS e FROM k)"""


@query(f"""WITH {_INDEX} SELECT doc_id, chunk_id, CAST(len(ls) AS INTEGER) AS n_lines, {Q.classify("e[1]", "e[2]", "e[3]", "e[4]")} AS rhyme_scheme, array_to_string(list_transform(e, lambda y: coalesce(y, '-')), ' ') AS end_suffixes FROM e""")
def verse_chunks_overlap(spark, sf):
    ends = F.array_join(F.transform("end_suffixes", lambda y: F.coalesce(y, F.lit("-"))), " ")
    return L.index_chunks(docs(spark, sf), "doc_id").select("doc_id", "chunk_id", F.size("lines").alias("n_lines"), "rhyme_scheme", ends.alias("end_suffixes"))


@query(f"""WITH {_INDEX}, c AS (SELECT {Q.classify("e[1]", "e[2]", "e[3]", "e[4]")} AS rhyme_scheme FROM e), n AS (SELECT rhyme_scheme, count(*) AS n FROM c GROUP BY 1)
SELECT rhyme_scheme, n, round(n::DOUBLE / sum(n) OVER (), 4) AS share FROM n""")
def chunk_scheme_distribution(spark, sf):
    n = L.index_chunks(docs(spark, sf), "doc_id").groupBy("rhyme_scheme").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("rhyme_scheme", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


@query(f"""WITH {Q.chunks(Q.lines("text"), 8, 8, 8, "source")} SELECT source, count(*) AS n_chunks, count(DISTINCT array_to_string(ls, chr(10))) AS n_distinct FROM k GROUP BY source""")
def exact_size_chunks(spark, sf):
    rows = L.chunks(docs(spark, sf), text.stripped_lines(F.col("text")), 8, 8, 8, "source").groupBy("source", F.xxhash64("lines").alias("h")).agg(F.count("*").alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"))


@query(f"""WITH r AS (SELECT source, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT source, doc_id, list_filter({Q.lines("text")}, lambda z: length(z) > 10) AS ls FROM documents)),
s AS (SELECT source, doc_id, line_no, substr(line, 1, 40) AS starter FROM r WHERE line_no % 16 = 0 AND length(line) < 80),
o AS (SELECT *, row_number() OVER (PARTITION BY source, lower(starter) ORDER BY doc_id, line_no) AS k FROM s),
n AS (SELECT source, starter, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS starter_no FROM o WHERE k = 1)
SELECT source, CAST(starter_no AS INTEGER) AS starter_no, starter FROM n WHERE starter_no <= 50""")
def artist_starters(spark, sf):
    return L.artist_starters(docs(spark, sf))


_PARTS = f"list_transform({Q.lines('text', fed_only=True)}, lambda y: CASE WHEN length(y) >= 40 AND regexp_matches(y, {Q.q(text.BREAK)}) THEN [y, {Q.strip(f'substr(y, 1, strpos(y, regexp_extract(y, {Q.q(text.BREAK)})) - 1)')}, {Q.strip(f'substr(y, strpos(y, regexp_extract(y, {Q.q(text.BREAK)})) + length(regexp_extract(y, {Q.q(text.BREAK)})))')}] ELSE [y] END)"


@query(f"""WITH p AS (SELECT doc_id, {_PARTS} AS p FROM documents),
n AS (SELECT doc_id, len(p) AS n, flatten(list_transform(p, lambda v: CASE WHEN len(v) = 3 AND length(v[2]) > 10 AND length(v[3]) > 10 THEN v[2:] ELSE v[1:1] END)) AS ls FROM p)
SELECT doc_id, array_to_string(ls, chr(10)) AS text FROM n WHERE len(ls) > n""")
def bar_split(spark, sf):
    return L.once(docs(spark, sf), text.bar_split(F.col("text")), "doc_id").where("text is not null")


@query(f"""WITH {Q.chunks(Q.lines("text"), 16, 16, 8, "source, doc_id", "length(text) >= 100")}
SELECT doc_id, chunk_id, '<|artist|>' || source || '<|verse|>' || chr(10) || array_to_string(ls, chr(10)) || chr(10) || '<|end|>' AS sample FROM k""")
def hf_format(spark, sf):
    rows = L.chunks(docs(spark, sf).where(F.length("text") >= 100), text.stripped_lines(F.col("text")), 16, 16, 8, "source", "doc_id")
    return rows.select("doc_id", "chunk_id", text.training_format(F.col("source"), F.array_join("lines", "\n")).alias("sample"))


@query(f"""WITH d AS (SELECT conv_id, turn, {Q.lines("text", fed_only=True)} AS ls FROM conversations), s AS (SELECT *, list_position(list_transform(ls, lambda y: regexp_matches(y, {Q.q(text.STOP_LINE)})), true) AS stop FROM d),
h AS (SELECT conv_id, turn, CASE WHEN coalesce(stop, 0) > 0 THEN ls[1 : stop - 1] ELSE ls END AS ls FROM s)
SELECT conv_id, turn, array_to_string(list_filter(ls, lambda z: length(z) >= 2 AND NOT ({" OR ".join(f"starts_with(z, {Q.q(p)})" for p in text.META_PREFIXES)}))[1:12], chr(10)) AS verse FROM h""")
def generated_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.generated_lines(F.col("text"), 12), "\n").alias("verse"))


@query("""SELECT conv_id, string_agg('<|' || role || '|>' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id""")
def conversation_corpus(spark, sf):
    part = F.concat(F.lit("<|"), "role", F.lit("|>"), "text")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", part.alias("p"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "p"))), lambda x: x["p"]), "\n\n").alias("text"))


# verse metrics

_M = "coalesce(text, '')"
_ML = f"list_filter({Q.split(Q.strip(_M))}, lambda z: {Q.strip('z')} <> '')"


def _distinct(n: int) -> str:
    return f"CASE WHEN len(ws) >= {n} THEN round(len(list_distinct(list_transform(range(1, len(ws) - {n - 2}), lambda g: array_to_string(ws[g : g + {n - 1}], ' '))))::DOUBLE / (len(ws) - {n - 1}), 4) ELSE 0.0 END AS distinct_{n}"


_METRICS = f"""d AS (SELECT doc_id, source, {Q.words(_M)} AS ws, {Q.lines(_M)} AS ls, {_ML} AS rl FROM documents),
e AS (SELECT *, list_filter(list_transform(ls, lambda y: {Q.last_suffix("y")}), lambda z: z IS NOT NULL) AS es FROM d),
m AS (SELECT doc_id, source, {", ".join(_distinct(n) for n in (1, 2, 3))},
  CASE WHEN len(ls) >= 2 THEN round(len(list_filter(es, lambda y: len(list_filter(es, lambda z: z = y)) > 1))::DOUBLE / len(ls), 4) ELSE 0.0 END AS rhyme_density,
  CAST(len(rl) AS BIGINT) AS num_lines, round(coalesce(list_sum(list_transform(rl, lambda y: length(y))), 0)::DOUBLE / greatest(len(rl), 1), 1) AS avg_line_length,
  round(len(list_distinct(rl))::DOUBLE / greatest(len(rl), 1), 3) AS unique_line_ratio,
  round(len(list_filter(rl, lambda y: length(y) BETWEEN 5 AND 120))::DOUBLE / greatest(len(rl), 1), 3) AS reasonable_line_ratio FROM e)"""


@query(f"WITH {_METRICS} SELECT * EXCLUDE (source) FROM m")
def verse_metrics(spark, sf):
    return quality.verse_metrics(docs(spark, sf), "doc_id")


_MS = ("distinct_1", "rhyme_density", "avg_line_length")


@query(f"WITH {_METRICS} SELECT source, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std' for m in _MS)} FROM m GROUP BY source")
def metrics_mean_std(spark, sf):
    return quality.mean_std(quality.verse_metrics(docs(spark, sf), "source", "doc_id"), list(_MS), "source", digits=6)


@query(f"""WITH {Q.chunks(Q.verse("text"), 16, 16, 8, "doc_id")},
r AS (SELECT doc_id, chunk_id, len(ls) AS n, unnest(range(len(ls))) AS i, unnest(list_transform(ls, lambda y: {Q.suffix(Q.end_word("y"))})) AS s FROM k),
p AS (SELECT *, list_extract({Q.group_list("AABB", 16)}, i + 1) AS g, {", ".join(f"lead(s, {j}) OVER v AS s{j}" for j in (1, 2, 3, 4))} FROM r WINDOW v AS (PARTITION BY doc_id, chunk_id ORDER BY i)),
a AS (SELECT *, arg_min(s, i) FILTER (WHERE s IS NOT NULL) OVER (PARTITION BY doc_id, chunk_id, g) AS anchor, row_number() OVER (PARTITION BY doc_id, chunk_id, g ORDER BY i) AS gi FROM p),
t AS (SELECT doc_id, chunk_id, CAST(any_value(n) AS INTEGER) AS n_lines, CAST(sum({" + ".join(f"coalesce(s = s{j}, false)::INT" for j in (1, 2, 3, 4))}) AS INTEGER) AS pairs,
  CAST(sum((gi > 1 AND coalesce(s = anchor, false))::INT) AS INTEGER) AS hits, count(s) AS known FROM a GROUP BY doc_id, chunk_id)
SELECT doc_id, chunk_id, n_lines, pairs, hits, CASE WHEN n_lines < 8 THEN -1.0::DOUBLE WHEN known::DOUBLE / n_lines < 0.5 THEN -0.5::DOUBLE
  ELSE (pairs + 0.5::DOUBLE * hits) * least(n_lines / 16.0::DOUBLE, 1.0) + 0.5::DOUBLE * least(n_lines / 16.0::DOUBLE, 1.0) END AS score FROM t""")
def score_candidates(spark, sf):
    return quality.score_verses(L.verse_chunks(docs(spark, sf), "doc_id"), "AABB", 16).select("doc_id", "chunk_id", "n_lines", "pairs", "hits", "score")


@query("SELECT quality_baseline, toxic_baseline FROM (SELECT max(n)::DOUBLE / sum(n) AS quality_baseline FROM (SELECT count(*) AS n FROM labels GROUP BY quality)), (SELECT max(n)::DOUBLE / sum(n) AS toxic_baseline FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def majority_baseline(spark, sf):
    t = table(spark, sf, "labels")
    a, b = (quality.majority_baseline(t, c).withColumnRenamed("baseline", f"{c}_baseline") for c in ("quality", "toxic"))
    return a.join(F.broadcast(b))


# vectors

FOUND = "WITH q AS (SELECT vec_id AS query_id, embedding AS query, label AS ql FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, ql, vec_id, label, list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) AS score FROM embeddings, q), "


def vector_queries(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("ql"))


def found(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"


@query(FOUND + f"r AS (SELECT *, {RANKED} AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def vector_topk(spark, sf):
    v, q = vector_queries(spark, sf)
    return found(retrieval.search(v, q, 5))


@query(SQL["vector_topk"])
def vector_topk_indexed(spark, sf):
    """The rows of ``vector_topk`` from an index in clusters that is written, read and searched by bounds."""
    v, q = vector_queries(spark, sf)
    path = f"{shared_dir(spark)}/strophe-index-{uuid.uuid4().hex}"
    vector_index.write_index(v, path)
    clusters = spark.read.parquet(f"{path}/clusters")
    return found(vector_index.search_index(vector_index.read_vectors(spark, path, v), clusters, q.select("query_id", "query"), 5)[0])


@query(FOUND + f"r AS (SELECT *, {RANKED} AS rank FROM p WHERE label <> ql) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def vector_topk_filtered(spark, sf):
    v, q = vector_queries(spark, sf)
    return found(retrieval.search(v, q, 5, F.col("label") != F.col("ql")))


@query(FOUND + f"r AS (SELECT *, {RANKED} AS r FROM p), f AS (SELECT *, {RANKED} AS rank FROM r WHERE r <= 50 AND label <> ql) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM f WHERE rank <= 5")
def vector_topk_overfetch(spark, sf):
    v, q = vector_queries(spark, sf)
    return found(retrieval.search(v, q, 5, F.col("label") != F.col("ql"), "overfetch"))


@query(FOUND + f"r AS (SELECT query_id, vec_id, score + CASE WHEN label = ql THEN 0.15 ELSE 0 END AS score FROM p), k AS (SELECT *, {RANKED} AS rank FROM r) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM k WHERE rank <= 5")
def vector_topk_boosted(spark, sf):
    v, q = vector_queries(spark, sf)
    return found(retrieval.search(v, q, 5, prefer=F.col("label") == F.col("ql")))


@query()
def retrieve_diverse(spark, sf):
    v, q = vector_queries(spark, sf)
    best = retrieval.search(v, q, 30).join(docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    return retrieval.diverse(best, 5, F.col("label") == F.col("ql"))


@query("WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS neuron FROM embeddings), s AS (SELECT neuron, avg(v::DOUBLE) FILTER (label = 0) - avg(v::DOUBLE) FILTER (label <> 0) AS s FROM x GROUP BY neuron), r AS (SELECT *, row_number() OVER (ORDER BY abs(round(s, 9)) DESC, neuron) AS rank FROM s) SELECT CAST(neuron AS INTEGER) AS neuron, round(s, 6) AS selectivity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def neuron_selectivity(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("neuron", "v")).withColumn("v", F.col("v").cast("double"))
    return sequences.selectivity(rows, "neuron", "v", F.col("label") == 0, 10).select("neuron", F.round("selectivity", 6).alias("selectivity"), "rank")


# originality

_PROBE = f"pr AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, list_transform({Q.lines('text')}, lambda y: lower(y)) AS ls FROM documents)), po AS (SELECT * FROM pr WHERE length(line) >= 15)"
_KNOWN = f"kn AS (SELECT DISTINCT line FROM (SELECT unnest(list_transform({Q.lines('text')}, lambda y: lower(y))) AS line FROM benchmark) WHERE length(line) > 15)"


@query(f"WITH {_PROBE}, {_KNOWN} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM po WHERE line IN (SELECT line FROM kn)")
def copied_lines_exact(spark, sf):
    return originality.copied_lines(docs(spark, sf), table(spark, sf, "benchmark"), "doc_id")


@query(f"""WITH {_PROBE}, {_KNOWN}, p AS (SELECT DISTINCT line FROM po), pg AS (SELECT line, {Q.grams("line")} AS g FROM p), kg AS (SELECT line AS known_line, {Q.grams("line")} AS g FROM kn),
px AS (SELECT line, len(g) AS n, unnest(g) AS x FROM pg), kx AS (SELECT known_line, len(g) AS m, unnest(g) AS x FROM kg),
c AS (SELECT line, known_line, any_value(n) AS n, any_value(m) AS m, count(*) AS i FROM px JOIN kx USING (x) GROUP BY line, known_line)
SELECT line, known_line, round(i::DOUBLE / (n + m - i), 6) AS similarity FROM c WHERE i::DOUBLE / (n + m - i) > 0.85""")
def near_dup_lines(spark, sf):
    return originality.near_copies(docs(spark, sf), table(spark, sf, "benchmark")).withColumn("similarity", F.round("similarity", 6))


@query("""WITH i AS (SELECT text, unnest(range(1, length(text) - 24)) AS i FROM benchmark WHERE length(text) > 25), n AS (SELECT substr(text, i, 25) AS prefix, list_sort(list(DISTINCT substr(text, i + 25, 1))) AS cs FROM i GROUP BY 1)
SELECT prefix, array_to_string(cs, '') AS next_chars FROM n""")
def ngram_continuations(spark, sf):
    return originality.continuations(table(spark, sf, "benchmark")).select("prefix", F.array_join("next_chars", "").alias("next_chars"))


@query("""WITH i AS (SELECT text, unnest(range(1, length(text) - 24)) AS i FROM benchmark WHERE length(text) > 25), n AS (SELECT substr(text, i, 25) AS prefix, list_sort(list(DISTINCT substr(text, i + 25, 1))) AS cs FROM i GROUP BY 1),
p AS (SELECT doc_id, right(text, 25) AS tail, length(text) AS n FROM documents)
SELECT doc_id, coalesce(array_to_string(cs, ''), '') AS blocked FROM p LEFT JOIN n ON p.n >= 25 AND p.tail = n.prefix""")
def blocked_ngrams(spark, sf):
    index = originality.continuations(table(spark, sf, "benchmark"))
    return originality.blocked(docs(spark, sf).select("doc_id", "text"), index, "doc_id").select("doc_id", F.array_join("blocked", "").alias("blocked"))


# vocabularies and tokenizers


WORDS = f"v AS (SELECT DISTINCT {Q.bare('w')} AS word FROM (SELECT unnest({Q.words('text')}) AS w FROM documents)), s AS (SELECT word, {Q.suffix('word')} AS suffix FROM v WHERE regexp_matches(word, '^[a-z]+$'))"


def vocabulary(spark, sf) -> DataFrame:
    spelled = docs(spark, sf).select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''").distinct()  # few, so that the patterns go over few
    words = spelled.select(text.bare_word(F.col("w")).alias("word")).distinct()
    return words.where(F.col("word").rlike("^[a-z]+$")).withColumn("suffix", phonetics.spelled_suffix(F.col("word")))


def _group_words(spark, sf) -> DataFrame:
    v = vocabulary(spark, sf).where("suffix is not null")
    return v.join(v.groupBy("suffix").agg(F.count("*").alias("n_words")), "suffix").select("suffix", "word", "n_words")


@query(f"WITH {WORDS} SELECT suffix, word, count(*) OVER (PARTITION BY suffix) AS n_words FROM s WHERE suffix IS NOT NULL")
def rhyme_groups(spark, sf):
    """Every word of each group, a row a word; ``rhyming_words`` is the lookup of a group's first 100."""
    return _group_words(spark, sf)


@query(f"WITH {WORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY word) AS r, count(*) OVER (PARTITION BY suffix) AS n FROM s WHERE suffix IS NOT NULL) SELECT suffix, any_value(n) AS n_words, string_agg(word, ' ' ORDER BY word) AS words FROM r WHERE r <= 100 GROUP BY suffix")
def rhyming_words(spark, sf):
    """The first 100 words of each group by alphabet: the limit is the lookup's."""
    first = F.row_number().over(Window.partitionBy("suffix").orderBy("word"))
    most = _group_words(spark, sf).withColumn("r", first).where("r <= 100")
    return most.groupBy("suffix").agg(F.first("n_words").alias("n_words"), F.array_join(F.sort_array(F.collect_list("word")), " ").alias("words"))


@query(f"WITH {WORDS} SELECT suffix, CAST(row_number() OVER (ORDER BY suffix) AS INTEGER) AS id FROM (SELECT DISTINCT suffix FROM s WHERE suffix IS NOT NULL) UNION ALL SELECT '<NONE>', 0")
def rhyme_suffix_vocab(spark, sf):
    ids = numbered_values(vocabulary(spark, sf), "suffix")
    return ids.unionByName(spark.createDataFrame([("<NONE>", 0)], "suffix string, id int"))


@query("SELECT source, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def artist_vocab(spark, sf):
    return numbered_values(docs(spark, sf), "source")


@query(f"WITH {WORDS}, x AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM s) SELECT substr(word, 1, i) AS prefix, coalesce(string_agg(DISTINCT nullif(substr(word, i + 1, 1), ''), '' ORDER BY nullif(substr(word, i + 1, 1), '')), '') AS next_chars, bool_or(i = length(word)) AS is_word FROM x GROUP BY 1")
def prefix_table(spark, sf):
    return tokenizers.prefix_table(vocabulary(spark, sf)).select("prefix", F.array_join("next_chars", "").alias("next_chars"), "is_word")


_CV = "cv AS (SELECT c AS char, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents))"


@query(f"WITH {_CV} SELECT char, id FROM cv")
def char_vocab(spark, sf):
    return tokenizers.char_vocab(docs(spark, sf))


@query(f"WITH {_CV}, x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, unnest(range(length(text))) AS i FROM documents) SELECT doc_id, count(*) AS n_tokens, md5(string_agg(id::VARCHAR, ' ' ORDER BY i)) AS tokens_md5 FROM x JOIN cv ON c = char GROUP BY doc_id")
def char_encode(spark, sf):
    d = docs(spark, sf)
    out = tokenizers.char_encode(d, tokenizers.char_vocab(d), "doc_id")
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


_PC = r"wc AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\S+|\s')) AS word FROM documents) GROUP BY 1), px AS (SELECT n, word, unnest(range(1, length(word))) AS i FROM wc), pc AS (SELECT substr(word, i, 1) AS l, substr(word, i + 1, 1) AS r, CAST(sum(n) AS BIGINT) AS n FROM px GROUP BY 1, 2)"


@query(f'WITH {_PC} SELECT l AS "left", r AS "right", n FROM pc')
def bpe_pair_counts(spark, sf):
    words = tokenizers.word_counts(docs(spark, sf)).withColumn("tokens", tokenizers.characters(F.col("word")))
    return tokenizers.pair_counts(words)


@query(f'WITH {_PC} SELECT l AS "left", r AS "right", n FROM pc ORDER BY n DESC, l, r LIMIT 1')
def bpe_first_merge(spark, sf):
    return bpe_pair_counts(spark, sf).orderBy(F.desc("n"), "left", "right").limit(1)


def _bpe(spark, sf) -> tuple[list[tuple[str, str]], dict[str, int]]:
    return tokenizers.bpe_train(docs(spark, sf))


@query()
def bpe_train(spark, sf):
    merges, vocab = _bpe(spark, sf)
    return spark.createDataFrame([(i, a, b, vocab[a + b]) for i, (a, b) in enumerate(merges)], "rank int, left string, right string, id int")


@query()
def bpe_encode(spark, sf):
    return tokenizers.bpe_encode(docs(spark, sf), *_bpe(spark, sf))


# training sequences


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents), w AS (SELECT doc_id, c, unnest(range(0, len(c) - 65, 32)) AS s FROM t)
SELECT doc_id, CAST(s AS INTEGER) AS start, array_to_string(c[s + 1 : s + 64], '') AS x, array_to_string(c[s + 2 : s + 65], '') AS y FROM w""")
def lm_windows(spark, sf):
    rows = docs(spark, sf).select("doc_id", tokenizers.characters(F.col("text")).alias("tokens"))
    return sequences.lm_windows(rows, 64, 32, "doc_id").select("doc_id", "start", F.array_join("x", "").alias("x"), F.array_join("y", "").alias("y"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) > floor(count(*) OVER (PARTITION BY source) * 0.9::DOUBLE) AS is_val FROM documents")
def train_val_split(spark, sf):
    return sequences.split_by_position(docs(spark, sf).select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "is_val")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[^ \n\t]', '0', 'g'), '[ \n\t]', '1', 'g')) AS labels_md5, len(regexp_extract_all(text, '[ \n\t]')) AS n_boundaries FROM documents")
def word_boundary_labels(spark, sf):
    labels = sequences.boundary_marks(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(labels).alias("labels_md5"), F.regexp_count("text", F.lit(r"[ \n\t]")).cast("long").alias("n_boundaries"))


@query(rf"""SELECT doc_id, array_to_string(flatten(list_transform(regexp_extract_all(text, '[^ \n\t]+|[ \n\t]'), lambda w: list_transform(range(length(w)),
  lambda i: CASE WHEN regexp_matches(w, '^\s*$') THEN 0 ELSE least(greatest(1, len(regexp_extract_all({Q.bare("w")}, '[aeiouy]+'))), 6) END))), '') AS labels FROM documents""")
def syllable_labels(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(sequences.syllable_labels(F.col("text")), "").alias("labels"))


@query(f"""WITH r AS (SELECT doc_id, {Q.raw("text")} AS ls FROM documents), x AS (SELECT doc_id, ls, unnest(range(len(ls) - 1)) AS i FROM r)
SELECT doc_id, CAST(list_sum(list_transform(ls[1 : i + 1], lambda z: length(z))) + i AS INTEGER) AS pos, {Q.last_suffix("ls[i + 1]")} AS suffix,
  CASE WHEN {Q.syllables("ls[i + 1]")} <= 6 THEN 0 WHEN {Q.syllables("ls[i + 1]")} <= 9 THEN 1 WHEN {Q.syllables("ls[i + 1]")} <= 12 THEN 2 WHEN {Q.syllables("ls[i + 1]")} <= 15 THEN 3 ELSE 4 END AS bucket FROM x""")
def newline_labels(spark, sf):
    return sequences.newline_labels(docs(spark, sf), "doc_id")


# decoding steps: an embedding stands for the logits of a step

LOGITS = "lg AS (SELECT vec_id AS step, unnest(embedding)::DOUBLE AS logit, unnest(range(len(embedding))) AS token FROM embeddings)"


def logits(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("step"), F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


@query(f"WITH {LOGITS}, r AS (SELECT *, rank() OVER (PARTITION BY step ORDER BY logit DESC) AS r FROM lg) SELECT step, CAST(token AS INTEGER) AS token, round(logit, 6) AS logit FROM r WHERE r <= 5")
def top_k_filter(spark, sf):
    return sequences.top_k_mask(logits(spark, sf), "step", 5).select("step", "token", F.round("logit", 6).alias("logit"))


@query(f"""WITH {LOGITS}, e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY step)) / 0.1) AS e FROM lg), p AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY step ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p AS b FROM p) SELECT step, CAST(token AS INTEGER) AS token, round(p, 6) AS p FROM c WHERE b < 0.5""")
def top_p_filter(spark, sf):
    probs = sequences.softmax(logits(spark, sf), "step", 0.1)
    return sequences.top_p_mask(probs, "step", "token", 0.5).select("step", "token", F.round("p", 6).alias("p"))


@query(f"""WITH {LOGITS}, g AS (SELECT step, arg_max(token, struct_pack(l := logit, t := -token)) AS token FROM lg GROUP BY step)
SELECT step, CAST(token AS INTEGER) AS token, round(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.token = lg.token AND g.step BETWEEN lg.step - 10 AND lg.step - 1)
  THEN CASE WHEN logit > 0 THEN logit / 1.2::DOUBLE ELSE logit * 1.2::DOUBLE END ELSE logit END, 6) AS logit FROM lg""")
def repetition_penalty(spark, sf):
    """Tokens that one of the ten steps before takes are penalised; a step takes its likeliest token."""
    rows = logits(spark, sf)
    taken = rows.groupBy("step").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("token"))
    recent = taken.select(F.explode(F.sequence(F.col("step") + 1, F.col("step") + 10)).alias("step"), "token").distinct().withColumn("recent", F.lit(True))
    rows = rows.join(recent, ["step", "token"], "left").withColumn("recent", F.coalesce("recent", F.lit(False)))
    return rows.select("step", "token", F.round(sequences.repetition_penalty(F.col("logit"), F.col("recent"), 1.2), 6).alias("logit"))


@query(f"""WITH {LOGITS}, e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY step)) / 0.1) AS e FROM lg), p AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM e),
c AS (SELECT step, token, sum(p) OVER (PARTITION BY step ORDER BY token ROWS UNBOUNDED PRECEDING) AS c FROM p)
SELECT step, CAST(min(token) AS INTEGER) AS token FROM c WHERE c > ({Q.keyed(0, "step")} % 1073741824) / 1073741824.0::DOUBLE GROUP BY step""")
def sampled_tokens(spark, sf):
    return sequences.sample(sequences.softmax(logits(spark, sf), "step", 0.1), "step", "token")


# augmentation


_FED = Q.lines("text", fed_only=True)


@query(f"""WITH d AS (SELECT doc_id, {_FED} AS ls FROM documents), r AS (SELECT doc_id, ls, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d WHERE len(ls) >= 4),
o AS (SELECT *, CASE WHEN i < len(ls) // 4 * 4 THEN {Q.keyed(0, "doc_id", "i")} ELSE i END AS o FROM r),
n AS (SELECT doc_id, any_value(array_to_string(ls, chr(10))) AS old, string_agg(x, chr(10) ORDER BY i // 4, o, x) AS text FROM o GROUP BY doc_id)
SELECT doc_id, text FROM n WHERE text <> old""")
def shuffle_blocks(spark, sf):
    return augment.shuffled_blocks(docs(spark, sf), "doc_id")


@query(f"""WITH d AS (SELECT source, doc_id, {_FED} AS ls FROM documents), r AS (SELECT source, doc_id, ls, unnest(range(len(ls) // 8)) AS chunk FROM d),
c AS (SELECT source, doc_id, array_to_string(ls[chunk * 8 + 1 : chunk * 8 + 8], chr(10)) AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk) - 1 AS j, count(*) OVER (PARTITION BY source) AS m,
  count(*) OVER (PARTITION BY source, doc_id) AS c FROM r),
s AS (SELECT *, min(j) OVER (PARTITION BY source, doc_id) AS s FROM c),
f AS (SELECT source, text, m, CASE WHEN m = c THEN j ELSE s END AS at, CASE WHEN m = c THEN 1 ELSE c END AS width FROM s WHERE m >= 2 AND j = {Q.keyed(0, "source", "0")} % m),
g AS (SELECT *, {Q.keyed(1, "source", "0")} % (m - width) AS r FROM f)
SELECT g.source, 0::BIGINT AS draw, g.text || chr(10) || c.text AS text FROM g JOIN c ON g.source IS NOT DISTINCT FROM c.source AND c.j = CASE WHEN r < g.at THEN r ELSE r + width END""")
def recombine(spark, sf):
    return augment.recombined(docs(spark, sf), "source", "doc_id")


_OPTIONS = " ".join(f"WHEN {Q.q(w)} THEN {r}" for w, r in sorted(augment.SYNONYMS.items()))


@query(f"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS ps FROM documents), x AS (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM p),
o AS (SELECT *, CASE lower(x) {_OPTIONS} END AS o FROM x),
n AS (SELECT *, CASE WHEN o IS NOT NULL AND {Q.keyed(0, "doc_id", "i")} % 1000000 < 300000 THEN o[({Q.keyed(1, "doc_id", "i")} % len(o) + 1)::INT] END AS w FROM o),
t AS (SELECT doc_id, string_agg(CASE WHEN w IS NULL THEN x WHEN regexp_matches(x, '^[A-Z]') THEN upper(w[1:1]) || w[2:] ELSE w END, '' ORDER BY i) AS text FROM n GROUP BY doc_id)
SELECT doc_id, t.text FROM t JOIN documents d USING (doc_id) WHERE t.text <> d.text""")
def synonym_swap(spark, sf):
    return augment.swapped_synonyms(docs(spark, sf), "doc_id")


@query()
def augment_dataset(spark, sf):
    return augment.augmented(docs(spark, sf))


# run logs


@query("SELECT user_id AS run, event_type AS metric, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM events GROUP BY 1, 2")
def run_metrics(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")
    return quality.mean_std(rows, ["value"], "run", "metric", digits=6)


@query("WITH r AS (SELECT event_type AS metric, user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1, 2) SELECT metric, count(*) AS n, round(avg(m), 6) AS mean_mean, round(stddev_pop(m), 6) AS mean_std, round(avg(s), 6) AS std_mean, round(stddev_pop(s), 6) AS std_std FROM r GROUP BY metric")
def run_metrics_second_level(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), "user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return quality.mean_std(rows, ["mean", "std"], "metric", digits=6)


@query("SELECT user_id AS run, event_type AS metric, arg_max(value, event_id) AS last_value, count(*) AS n FROM events GROUP BY 1, 2")
def run_last(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "event_id", "value")
    return runs.last_metrics(rows, order="event_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2")
def run_metrics_windowed(spark, sf):
    out = windowed(table(spark, sf, "events"), "ts", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_E = "PARTITION BY user_id, event_type ORDER BY event_id"


@query(f"""WITH b AS (SELECT user_id, event_type, event_id, value, min(value) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(value) OVER ({_E} ROWS UNBOUNDED PRECEDING) AS best,
  row_number() OVER ({_E}) AS n FROM events), c AS (SELECT *, max(CASE WHEN before IS NULL OR value < before THEN n END) OVER ({_E} ROWS UNBOUNDED PRECEDING) AS b FROM b)
SELECT user_id, event_type, event_id, best, CAST(n - b AS BIGINT) AS since_best FROM c""")
def early_stopping(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return quality.evals_since_best(rows, ["user_id", "event_type"], "event_id", "value").select("user_id", "event_type", "event_id", "best", "since_best")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS total FROM events), w AS (SELECT *, total // 10 AS warm FROM n)
SELECT user_id, event_id, round(CASE WHEN step < warm THEN step / warm::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * (step - warm) / (total - warm)::DOUBLE)) END, 6) AS factor FROM w""")
def lr_schedule(spark, sf):
    """Each user's events as the steps of a run, a tenth of them warm-up."""
    rows = numbered(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")
    return rows.select("user_id", "event_id", F.round(quality.learning_rate(F.col("_no") - 1, F.floor(F.col("_all") / 10), F.col("_all")), 6).alias("factor"))


@query("SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity_by_metric(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(quality.perplexity(F.col("value") / 100), 6).alias("perplexity"))


# web pages and characters

_LINKS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, CAST(len({_LINKS}) AS BIGINT) AS n_links, array_to_string({_LINKS}, ' ') AS links FROM pages")
def page_links(spark, sf):
    links = text.page_links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _e, _p in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_p}')"


@query(f"SELECT page_id, array_to_string({Q.lines(_HTML)}, chr(10)) AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.page_text(F.col("html")).alias("text"))


@query(r"SELECT source, CASE WHEN regexp_matches(lower(c), '^[aeiou]$') THEN 'vowel' WHEN regexp_matches(lower(c), '^[a-z]$') THEN 'consonant' WHEN regexp_matches(c, '^[0-9]$') THEN 'digit' WHEN regexp_matches(c, '^\s$') THEN 'whitespace' ELSE 'punct' END AS class, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, c, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY 1, 2) GROUP BY 1, 2")
def char_class_counts(spark, sf):
    chars = docs(spark, sf).select("source", F.explode(tokenizers.characters(F.col("text"))).alias("c")).groupBy("source", "c").agg(F.count("*").alias("n"))
    return chars.groupBy("source", text.char_class(F.col("c")).alias("class")).agg(F.sum("n").alias("n"))


# the other queries register themselves
from . import dataset_queries, decoding_queries, profile_queries  # noqa: E402, F401
