"""SQL snippets that say in DuckDB what ``functions`` says in Spark. For checks only."""

from __future__ import annotations

from ..functions import scheme as S
from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def raw(t: str) -> str:
    return f"string_split({t}, chr(10))"


def split(t: str) -> str:
    return rf"string_split_regex({t}, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"


def lines(t: str, fed_only: bool = False) -> str:
    return f"list_filter(list_transform({raw(t) if fed_only else split(t)}, lambda x0: {strip('x0')}), lambda x1: x1 <> '')"


def keyed(seed: int, *key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in key)})), 1, 15))::BIGINT"


def style(t: str) -> str:
    return f"list_filter({lines(t)}, lambda x2: NOT regexp_matches(x2, {q(T.HEADER)}) AND length(x2) >= 3)"


def page(t: str) -> str:
    body = f"CASE WHEN contains({split(t)}[1], 'Lyrics') THEN {split(t)}[2:] ELSE {split(t)} END"
    keep = f"x4 <> '' AND NOT regexp_matches(x4, {q(T.HEADER)}) AND NOT regexp_matches(x4, {q(T.PAGE_NOISE)}) AND (length(x4) >= 3 OR regexp_matches(x4, '^\\p{{L}}'))"
    return f"list_filter(list_transform({body}, lambda x3: {strip('x3')}), lambda x4: {keep})"


def verse(t: str) -> str:
    return f"list_filter({lines(t)}, lambda x5: NOT ({' OR '.join(f'contains(x5, {q(p)})' for p in T.VERSE_NOISE)}))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w0: w0 <> '')"


def bare(w: str, marks: str = T.PUNCTUATION) -> str:
    return f"regexp_replace(lower({w}), {q(f'^{marks}+|{marks}+$')}, '', 'g')"


def end_word(x: str) -> str:
    return rf"list_filter(list_transform({words(x)}, lambda w1: {bare('w1', T.END_PUNCTUATION)}), lambda w2: regexp_matches(w2, '\p{{L}}'))[-1]"


def suffix(w: str) -> str:
    return f"nullif(regexp_extract({w}, '([aeiouy]+[^aeiouy]*)$', 1), '')"


def last_suffix(x: str) -> str:
    return suffix(bare(f"{words(x)}[-1]"))


def syllables(x: str) -> str:
    return f"coalesce(list_sum(list_transform({words(x)}, lambda w3: greatest(1, len(regexp_extract_all({bare('w3')}, '[aeiouy]+'))))), 0)"


def classify(a: str, b: str, c: str, d: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {c} IS NULL OR {d} IS NULL THEN 'unknown' WHEN {a} = {b} AND {b} = {c} AND {c} = {d} THEN 'AAAA' "
        f"WHEN {a} = {b} AND {c} = {d} THEN 'AABB' WHEN {a} = {c} AND {b} = {d} THEN 'ABAB' WHEN {a} = {d} AND {b} = {c} THEN 'ABBA' ELSE 'irregular' END"
    )


def chunks(t: str, size: int, stride: int, least: int, cols: str, where: str = "true") -> str:
    return f"""k0 AS (SELECT {cols}, {t} AS ls FROM documents WHERE {where}),
k1 AS (SELECT {cols}, ls, unnest(range(0, len(ls), {stride})) AS i FROM k0),
k AS (SELECT {cols}, CAST(i // {stride} AS INTEGER) AS chunk_id, ls[i + 1 : i + {size}] AS ls FROM k1 WHERE len(ls[i + 1 : i + {size}]) >= {least})"""


#: l(source, doc_id, line_no, line) and w(source, a, b, c, d): lines of texts of 50 or more characters, runs of four suffixes.
LINES = f"""l AS (SELECT source, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT source, doc_id, {style("text")} AS ls FROM documents WHERE length(text) >= 50))"""
RUNS = f"""w0 AS (SELECT source, s AS a, lead(s, 1) OVER v AS b, lead(s, 2) OVER v AS c, lead(s, 3) OVER v AS d, row_number() OVER v AS rn, count(*) OVER (PARTITION BY source) AS n
  FROM s WINDOW v AS (PARTITION BY source ORDER BY doc_id, line_no)),
w AS (SELECT * FROM w0 WHERE rn <= n - 3),
c AS (SELECT source, {classify("a", "b", "c", "d")} AS scheme FROM w)"""
WINDOWS = f"""{LINES},
s AS (SELECT source, doc_id, line_no, {suffix(end_word("line"))} AS s FROM l),
{RUNS}"""


def grams(x: str, n: int = 5) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda g0: substr({x}, g0, {n})))"


def group_list(scheme: str, most: int) -> str:
    return str(S.groups(scheme, most))
