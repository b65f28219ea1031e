"""Texts made of columns: prompts, profile cards and table rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# What schemes are called in prompts and on cards.
PROMPT_SCHEMES = {
    "AABB": "AABB couplets (lines 1+2 rhyme, 3+4 rhyme)",
    "ABAB": "ABAB alternating rhymes",
    "ABBA": "ABBA enclosed rhymes",
    "AAAA": "AAAA — same rhyme held across multiple bars",
    "free": "free verse",
}
CARD_SCHEMES = {
    "AABB": "AABB couplets — lines 1+2 rhyme, then 3+4 rhyme",
    "ABAB": "ABAB alternating — line 1 with line 3, line 2 with line 4",
    "ABBA": "ABBA enclosed — outer pair rhymes, inner pair rhymes",
    "AAAA": "AAAA — same rhyme held across every bar (multisyllabic chains)",
    "free": "free verse — no fixed pattern",
    "irregular": "no consistent pattern detected",
}


def named(scheme: Column, names: dict[str, str]) -> Column:
    """What ``names`` calls a scheme, or the scheme itself."""
    out = scheme
    for key, name in names.items():
        out = F.when(scheme == key, name).otherwise(out)
    return out


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def profile_card(artist: Column) -> Column:
    """Markdown card of a profile's columns; a row without a profile (null dominant_scheme) says so."""
    words = F.slice(F.coalesce("signature_words", F.array().cast("array<string>")), 1, 8)
    lines = [
        F.concat(F.lit("### Studied profile: "), artist, F.lit("\n")),
        F.concat(F.lit("- **Rhyme scheme:** `"), "dominant_scheme", F.lit("` — "), named(F.col("dominant_scheme"), CARD_SCHEMES), F.lit(" ("), percent(F.col("scheme_confidence_named")), F.lit(" of clean patterns)")),
        F.format_string("- **Bar length:** %.1f syllables (±%.1f)", "avg_syllables", F.col("syllable_stddev")),
        F.concat(F.lit("- **Rhyme density:** "), percent(F.col("rhyme_density")), F.lit(" of adjacent bars rhyme")),
        F.concat(F.lit("- **Contraction rate:** "), percent(F.col("contraction_rate")), F.lit(" (casual / AAVE intensity)")),
        F.when(F.size(words) > 0, F.concat(F.lit("- **Signature words:** `"), F.array_join(words, "`, `"), F.lit("`"))),
    ]
    card = F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))
    return F.when(F.col("dominant_scheme").isNull(), F.concat(F.lit("_No style profile available for "), artist, F.lit("_"))).otherwise(card)


def prompt(topic: Column, artist: Column, examples: Column, most: int = 3, cap: int | None = None) -> Column:
    """A few-shot prompt of a profile's columns (null dominant_scheme: none), ``most`` example texts of at most ``cap`` lines, and a topic."""
    none = F.col("dominant_scheme").isNull()
    words = F.slice(F.coalesce("signature_words", F.array().cast("array<string>")), 1, 8)
    shown = F.slice(examples, 1, most)
    body = lambda x: text.strip(x) if cap is None else F.array_join(text.first_lines(text.strip(x), cap), "\n")
    verses = F.flatten(F.transform(shown, lambda x, i: F.array(F.concat(F.lit("Verse "), (i + 1).cast("string"), F.lit(":")), body(x), F.lit(""))))
    about = [
        F.when(~none, F.concat(artist, F.lit(" writes in "), named(F.col("dominant_scheme"), PROMPT_SCHEMES), F.lit("."))),
        F.when(~none, F.concat(F.lit("Average bar length: "), F.bround("avg_syllables", 0).cast("long").cast("string"), F.lit(" syllables."))),
        F.when(~none & (F.size(words) > 0), F.concat(artist, F.lit("'s signature vocabulary includes: "), F.array_join(words, ", "), F.lit("."))),
        F.when(~none, F.lit("")),
        F.concat(F.lit("Rap verses by "), artist, F.lit(":\n")),
    ]
    n = (F.size(shown) + 1).cast("string")
    plain = none | F.col("dominant_scheme").isin("free", "irregular")
    last = F.when(plain, F.concat(F.lit("Verse "), n, F.lit(" — "), topic, F.lit(":"))).otherwise(F.concat(F.lit("Verse "), n, F.lit(" by "), artist, F.lit(" ("), "dominant_scheme", F.lit(" rhyme scheme) about "), topic, F.lit(":")))
    return F.array_join(F.concat(F.array_compact(F.array(*about)), verses, F.array(last)), "\n")


def result_row(name: Column, metrics: list[str]) -> Column:
    """A fixed-width row of a table of runs: name, then mean and deviation of each metric."""
    cells = [F.format_string(" | %7.4f +/- %.4f", F.coalesce(f"{m}_mean", F.lit(0.0)), F.coalesce(f"{m}_std", F.lit(0.0))) for m in metrics]
    return F.concat(F.rpad(name, 25, " "), *cells)


def comparison_row(name: Column, params: Column, metrics: list[str]) -> Column:
    """The same for models, with their size in thousands groups."""
    cells = [F.format_string(" | %6.3f+/-%.3f", F.coalesce(f"{m}_mean", F.lit(0.0)), F.coalesce(f"{m}_std", F.lit(0.0))) for m in metrics]
    return F.concat(F.rpad(name, 25, " "), F.lit(" "), F.lpad(F.format_number(params, 0), 10, " "), *cells)


def header_row(metrics: list[str], params: bool = False) -> str:
    head = f"{'Model':<25} {'Params':>10}" if params else f"{'Name':<25}"
    return head + "".join(f" | {m:<{16 if params else 18}}" for m in metrics)
