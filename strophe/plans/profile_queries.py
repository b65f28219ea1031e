"""Queries of whole profiles, of a lexicon's rhymes and of texts made of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phonetics, reports, text
from ..operators import lines as L
from ..operators import profiles, quality, tokenizers
from ..operators.following import numbered
from . import sql as Q
from .queries import SQL, docs, query, table, vocabulary

# the parts' SQL, each as a table
_PARTS = {"st": "line_statistics_by_source", "sc": "scheme_profile_by_source", "di": "scheme_distribution_by_source", "pa": "adjacent_rhyme_density_by_source", "si": "signature_words_by_source"}
_TABLES = ", ".join(f"{k} AS ({SQL[v]})" for k, v in _PARTS.items())


@query(f"""WITH {_TABLES},
d AS (SELECT source, string_agg(scheme || ':' || printf('%.3f', share), ' ' ORDER BY scheme) AS scheme_distribution FROM di GROUP BY source),
w AS (SELECT source, string_agg(word, ' ' ORDER BY rank) AS signature_words FROM si GROUP BY source)
SELECT st.*, sc.* EXCLUDE (source), d.scheme_distribution, pa.rhyme_density, w.signature_words FROM st LEFT JOIN sc USING (source) LEFT JOIN d USING (source) LEFT JOIN pa USING (source) LEFT JOIN w USING (source)""")
def style_profiles(spark, sf):
    """Every field of a profile; the map and the array as texts, so that they compare."""
    entries = F.transform(F.array_sort(F.map_entries("scheme_distribution")), lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.3f", e["value"])))
    out = profiles.style_profiles(docs(spark, sf))
    return out.withColumn("scheme_distribution", F.array_join(entries, " ")).withColumn("signature_words", F.array_join("signature_words", " "))


# a lexicon: here one phone a letter, vowels stressed, made from the corpus's own words


def _lexicon(spark, sf) -> DataFrame:
    """As large as the corpus's vocabulary: words of lines meet it by hash, so that they aren't sorted for it."""
    phones = F.transform(tokenizers.characters(F.col("word")), lambda x: F.concat(F.upper(x), F.when(x.rlike("[aeiouy]"), "1").otherwise("")))
    return vocabulary(spark, sf).select("word", F.lit(0).alias("variant"), phones.alias("phones")).hint("shuffle_hash")


def _by_letters(w: str) -> str:
    """The lexicon's suffix of an end word in SQL: known words are of plain letters."""
    last = f"regexp_extract({w}, '([aeiouy][^aeiouy]*)$', 1)"
    phones = f"list_transform(string_split({last}, ''), lambda x: CASE WHEN regexp_matches(x, '[aeiouy]') THEN upper(x) || '1' ELSE upper(x) END)"
    return f"CASE WHEN regexp_matches({w}, '^[a-z]+$') THEN nullif(array_to_string({phones}, ' '), '') END"


@query(f"""WITH {Q.LINES}, e AS (SELECT {Q.end_word("line")} AS w FROM l), s AS (SELECT {_by_letters("w")} AS suffix FROM e) SELECT suffix, count(*) AS n FROM s GROUP BY suffix""")
def lexicon_line_suffixes(spark, sf):
    rows = L.line_table(docs(spark, sf).where(F.length("text") >= 50), text.style_lines(F.col("text")), "source")
    return L.join_suffixes(rows, _lexicon(spark, sf)).groupBy("suffix").agg(F.count("*").alias("n"))


@query(f"""WITH {Q.LINES}, e AS (SELECT source, doc_id, line_no, {Q.end_word("line")} AS w FROM l), s AS (SELECT source, doc_id, line_no, {_by_letters("w")} AS s FROM e), {Q.RUNS}
SELECT source, scheme, count(*) AS n FROM c GROUP BY source, scheme""")
def lexicon_scheme_counts(spark, sf):
    return L.scheme_windows(docs(spark, sf), lexicon=_lexicon(spark, sf)).groupBy("source", "scheme").agg(F.count("*").alias("n"))


@query(f"""WITH {Q.LINES}, x AS (SELECT doc_id, line_no, list_transform({Q.words("line")}, lambda w: {Q.bare("w")}) AS ws FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(coalesce(list_sum(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^[a-z]+$') THEN len(regexp_extract_all(w, '[aeiouy]'))
  ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))) END)), 0) AS BIGINT) AS syllables FROM x""")
def lexicon_line_syllables(spark, sf):
    rows = L.line_table(docs(spark, sf).where(F.length("text") >= 50), text.style_lines(F.col("text")), "doc_id")
    return L.syllables_of_lines(rows, _lexicon(spark, sf), "doc_id")


@query("""WITH t(symbol, id) AS (VALUES ('B', 19), ('D', 21), ('F', 32), ('G', 33), ('K', 42), ('L', 43), ('M', 44), ('N', 45), ('P', 53), ('R', 54), ('S', 55), ('T', 57), ('V', 65), ('W', 66), ('Y', 67), ('Z', 68)), c AS (SELECT upper(c) AS letter, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]')) AS c FROM documents) GROUP BY 1)
SELECT letter, CAST(coalesce(id, 0) AS INTEGER) AS id, n FROM c LEFT JOIN t ON letter = symbol""")
def phoneme_ids(spark, sf):
    """The fixed ids of the letters of all texts that are phonemes by themselves, 0 (padding) for the others."""
    letters = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]"), F.lit(0))).alias("c")).groupBy(F.upper("c").alias("letter")).agg(F.count("*").alias("n"))
    ids = F.broadcast(phonetics.phonemes(spark).select("symbol", "id"))  # a fixed table
    return letters.join(ids, F.col("letter") == F.col("symbol"), "left").select("letter", F.coalesce("id", F.lit(0)).alias("id"), "n")


# texts made of profiles


def _profiles(spark, sf) -> DataFrame:
    return profiles.style_profiles(docs(spark, sf)).drop("scheme_distribution")


def _case(names: dict[str, str]) -> str:
    return f"CASE dominant_scheme {' '.join(f'WHEN {Q.q(k)} THEN {Q.q(v)}' for k, v in names.items())} ELSE dominant_scheme END"


def _percent(share: str) -> str:
    return f"CAST(round_even({share} * 100, 0) AS BIGINT)::VARCHAR || '%'"


_CARDS = f"""WITH {_TABLES}, w AS (SELECT source, list(word ORDER BY rank) AS ws FROM si GROUP BY source),
p AS (SELECT * FROM st LEFT JOIN sc USING (source) LEFT JOIN (SELECT source, rhyme_density FROM pa) USING (source) LEFT JOIN w USING (source))"""


@query(f"""{_CARDS} SELECT source, '### Studied profile: ' || source || chr(10) || chr(10) || '- **Rhyme scheme:** `' || dominant_scheme || '` — ' || {_case(reports.CARD_SCHEMES)} || ' (' || {_percent("scheme_confidence_named")} || ' of clean patterns)' || chr(10)
  || printf('- **Bar length:** %.1f syllables (±%.1f)', avg_syllables, round(syllable_stddev, 1)) || chr(10) || '- **Rhyme density:** ' || {_percent("rhyme_density")} || ' of adjacent bars rhyme' || chr(10)
  || '- **Contraction rate:** ' || {_percent("contraction_rate")} || ' (casual / AAVE intensity)' || chr(10) || CASE WHEN len(ws) > 0 THEN '- **Signature words:** `' || array_to_string(ws[1:8], '`, `') || '`' || chr(10) ELSE '' END AS card FROM p""")
def profile_cards(spark, sf):
    return _profiles(spark, sf).select("source", reports.profile_card(F.col("source")).alias("card"))


@query(f"""{_CARDS}, e AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), x AS (SELECT source, list(text ORDER BY r) AS ts FROM e WHERE r <= 2 GROUP BY source),
v AS (SELECT source, ts, list_transform(range(len(ts)), lambda i: 'Verse ' || (i + 1) || ':' || chr(10) || array_to_string(list_filter({Q.split(Q.strip("ts[i + 1]"))}, lambda y: {Q.strip("y")} <> '')[1:4], chr(10)) || chr(10)) AS vs FROM x)
SELECT source, source || ' writes in ' || {_case(reports.PROMPT_SCHEMES)} || '.' || chr(10) || 'Average bar length: ' || CAST(round_even(avg_syllables, 0) AS BIGINT) || ' syllables.' || chr(10)
  || CASE WHEN len(ws) > 0 THEN source || chr(39) || 's signature vocabulary includes: ' || array_to_string(ws[1:8], ', ') || '.' || chr(10) ELSE '' END || chr(10) || 'Rap verses by ' || source || ':' || chr(10) || chr(10)
  || array_to_string(vs, chr(10)) || chr(10)
  || CASE WHEN dominant_scheme IN ('free', 'irregular') THEN 'Verse ' || (len(ts) + 1) || ' — home:' ELSE 'Verse ' || (len(ts) + 1) || ' by ' || source || ' (' || dominant_scheme || ' rhyme scheme) about home:' END AS prompt FROM p JOIN v USING (source)""")
def prompts(spark, sf):
    """Two texts of four lines each as examples."""
    rows = numbered(docs(spark, sf).select("source", "doc_id", "text"), "source", "doc_id").where("_no <= 2")
    rows = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_no", "text"))).alias("x")).select("source", F.col("x.text").alias("examples"))
    out = _profiles(spark, sf).join(rows, "source")
    return out.select("source", reports.prompt(F.lit("home"), F.col("source"), F.col("examples"), cap=4).alias("prompt"))


@query("""WITH r AS (SELECT event_type AS metric, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT metric, rpad(metric, 25, ' ') || printf(' | %7.4f +/- %.4f', round(m, 4), round(s, 4)) AS ablation,
  rpad(metric, 25, ' ') || ' ' || lpad(format('{:,}', n), 10, ' ') || printf(' | %6.3f+/-%.3f', round(m, 3), round(s, 3)) AS comparison FROM r""")
def run_tables(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    four, three = (quality.mean_std(rows, ["value"], "metric", digits=d).alias(f"d{d}") for d in (4, 3))
    a = four.select("metric", reports.result_row(F.col("metric"), ["value"]).alias("ablation"))
    return a.join(three.select("metric", reports.comparison_row(F.col("metric"), F.col("n"), ["value"]).alias("comparison")), "metric")
