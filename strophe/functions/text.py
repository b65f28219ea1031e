"""Line and word expressions: every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cleaning rules.
HEADER = r"^\[.*\]$"
PAGE_NOISE = r"You might also like|Get tickets as low as|See .* Live|^\d+$|Embed$|Contributors"
WEB_NOISE = ("Embed", "You might also like", "See ", "Get tickets", "Contributors", "Translations", "pyright", "writer")
VERSE_NOISE = ("See ", "tickets as low as", "You might also like")
META_PREFIXES = ("(Left)", "(Right)", "This is ", "In this ", "These lyrics")
STOP_LINE = r"(?i)^(Verse\s*\d+|Rap verses by|\[Verse|\[Chorus)"
CONTRACTION = r"(?i)\b\w+'\w+\b|\b\w+in'\b|\bain't\b|\bgon'\b|\btryna\b|\bfinna\b|\bcuz\b|\bcuh\b"
BREAK = r"(?i),\s+|\s+and\s+|\s+but\s+|\s+'cause\s+|\s+then\s+|\s+so\s+|\s+like\s+"
_BREAK = r"(?i),\s+|\s+(?:and|but|'cause|then|so|like)\s+"  # the same matches, blanks gone through once
PUNCTUATION = r"""[.,!?;:'"()\-]"""
END_PUNCTUATION = r"""[.,!?;:'"()\-—…]"""
#: Whatever ends a line of a fetched text; rules for generated and augmented text know line feeds only.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_NOT_FED = r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Drop white space at both ends, not only blanks; a trim, as a pattern for each line would cost most of a scan."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def named(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: an array of one binds it to a name."""
    return F.transform(F.array(value), use)[0]


def raw_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def split_lines(text: Column) -> Column:
    """Lines by any line end; an empty text still has one empty line, which every rule here drops. Most texts have line feeds only."""
    return named(text, lambda t: F.when(t.rlike(_NOT_FED), F.split(t, LINE_END, -1)).otherwise(raw_lines(t)))


def stripped_lines(text: Column, fed_only: bool = False) -> Column:
    """Stripped lines that hold something, in order; with ``fed_only`` line feeds alone end lines."""
    return F.filter(F.transform(raw_lines(text) if fed_only else split_lines(text), strip), lambda x: x != "")


def is_header(line: Column) -> Column:
    return line.rlike(HEADER)


def contains_any(line: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | line.contains(p)
    return out


def is_page_noise(line: Column) -> Column:
    """Whether ``PAGE_NOISE`` matches somewhere in a stripped line; by parts, as all its alternatives at each character cost most of a scan."""
    fixed = contains_any(line, ("You might also like", "Get tickets as low as", "Contributors")) | line.endswith("Embed")
    return fixed | (line.contains("See ") & line.rlike("See .* Live")) | line.rlike(r"^\d+$")


def page_lines(text: Column) -> Column:
    """Lines of a fetched lyrics page: the title line, headers, page noise and short non-letters leave."""
    keep = lambda x: (x != "") & ~is_header(x) & ~is_page_noise(x) & ((F.length(x) >= 3) | x.rlike(r"^\p{L}"))
    return F.filter(F.transform(split_lines(text), strip), lambda x, i: ~((i == 0) & x.contains("Lyrics")) & keep(x))


def clean_page(text: Column) -> Column:
    return F.array_join(page_lines(text), "\n")


def clean_user_text(text: Column) -> Column:
    """Blank lines, headers and short non-letters leave."""
    return F.array_join(F.filter(stripped_lines(text), lambda x: ~is_header(x) & ((F.length(x) >= 3) | x.rlike(r"^\p{L}"))), "\n")


def clean_web_text(text: Column) -> Column:
    keep = lambda x: ~is_header(x) & ~contains_any(x, WEB_NOISE) & ~x.rlike(r"^\d+$") & (F.length(x) >= 3)
    return F.array_join(F.filter(stripped_lines(text), keep), "\n")


def style_lines(text: Column) -> Column:
    """Lines that profiles and chunks are made of: no headers, at least three characters."""
    return F.filter(stripped_lines(text), lambda x: ~is_header(x) & (F.length(x) >= 3))


def verse_lines(text: Column) -> Column:
    return F.filter(stripped_lines(text), lambda x: ~contains_any(x, VERSE_NOISE))


def generated_lines(text: Column, most: int) -> Column:
    """Lines before the first stop line, without meta lines and single characters, at most ``most``."""
    lines = stripped_lines(text, fed_only=True)
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(STOP_LINE)), True)
    head = F.when(stop > 0, F.slice(lines, 1, (stop - 1).cast("int"))).otherwise(lines)
    meta = lambda x: F.lit(False) if not META_PREFIXES else _starts(x)
    return F.slice(F.filter(head, lambda x: ~meta(x) & (F.length(x) >= 2)), 1, most)


def _starts(x: Column) -> Column:
    out = F.lit(False)
    for p in META_PREFIXES:
        out = out | x.startswith(p)
    return out


def first_lines(text: Column, most: int) -> Column:
    """The first non-blank lines, as they are."""
    return F.slice(F.filter(split_lines(text), lambda x: strip(x) != ""), 1, most)


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def bare_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), f"^{PUNCTUATION}+|{PUNCTUATION}+$", "")


def end_word(line: Column) -> Column:
    """The last word with a letter, lower-cased, without punctuation around it; null without one."""
    last = F.try_element_at(F.filter(words(line), lambda w: w.rlike(r"\p{L}")), F.lit(-1))
    return F.regexp_replace(F.lower(last), f"^{END_PUNCTUATION}+|{END_PUNCTUATION}+$", "")


def last_word(line: Column) -> Column:
    """The last word, whatever it is, lower-cased and without punctuation around it."""
    bare = strip(line)
    by_blank = F.nullif(F.substring_index(bare, " ", -1), F.lit(""))
    return bare_word(F.when(bare.rlike(r"[\t\n\x0B\f\r]"), F.try_element_at(words(line), F.lit(-1))).otherwise(by_blank))


def char_ngrams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters in order; none of a shorter text. Characters are split once, so that a long text takes linear time."""
    at = lambda c: F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1)))
    grams = lambda c: F.transform(at(c), lambda i: F.array_join(F.slice(c, i, n), ""))
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    # an array of one array binds it to a name
    return F.when(F.length(text) >= n, F.transform(F.array(chars), grams)[0]).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of the five-character substrings."""
    return jaccard(char_ngrams(a, 5), char_ngrams(b, 5))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_]", "")


def slug(name: Column, joint: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def char_class(c: Column) -> Column:
    """vowel, consonant, digit, whitespace or punct."""
    low = F.lower(c)
    return F.when(low.rlike("^[aeiou]$"), "vowel").when(low.rlike(r"^[a-z]$"), "consonant").when(c.rlike("^[0-9]$"), "digit").when(c.rlike(r"^\s$"), "whitespace").otherwise("punct")


def bar_split(text: Column) -> Column:
    """Lines of 40 or more characters split at their first break where both parts exceed ten; null where nothing is split."""

    def halves(x: Column, both: Column) -> Column:
        ends = F.array(strip(both[0]), strip(F.coalesce(F.try_element_at(both, F.lit(2)), F.lit(""))))
        return named(ends, lambda e: F.when((F.length(e[0]) > 10) & (F.length(e[1]) > 10), e).otherwise(F.array(x)))

    def parts(x: Column) -> Column:
        return F.when(F.length(x) >= 40, named(F.split(x, _BREAK, 2), lambda both: halves(x, both))).otherwise(F.array(x))

    def joined(lines: Column) -> Column:
        return named(F.flatten(F.transform(lines, parts)), lambda new: F.when(F.size(new) > F.size(lines), F.array_join(new, "\n")))

    return named(stripped_lines(text, fed_only=True), joined)


def training_format(artist: Column, verse: Column) -> Column:
    return F.concat(F.lit("<|artist|>"), artist, F.lit("<|verse|>\n"), verse, F.lit("\n<|end|>"))


def generated_part(text: Column) -> Column:
    """What follows the last verse mark, up to the first end mark."""
    return F.substring_index(F.substring_index(text, "<|verse|>", -1), "<|end|>", 1)


def first_generated_lines(text: Column, most: int = 8) -> Column:
    """The first stripped lines of the generated part."""
    return F.array_join(F.slice(stripped_lines(strip(generated_part(text)), fed_only=True), 1, most), "\n")


def page_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and comments leave, breaks and block ends become line ends, entities are resolved."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.array_join(stripped_lines(out), "\n")


# Which links of a site lead to songs.
LINK_RULES = {
    "lyrics.com": {"starts": ("/lyric/", "https://www.lyrics.com/lyric/"), "base": "https://www.lyrics.com", "least": 2, "digits": False},
    "azlyrics.com": {"holds": ("/lyrics/",), "ends": ".html", "base": "https://www.azlyrics.com"},
    "songlyrics.com": {"holds": ("songlyrics.com",), "ends": "-lyrics/"},
    "genius.com": {"holds": ("genius.com/", "-lyrics"), "least": 3, "once": True},
}


def song_links(html: Column, starts: tuple[str, ...] = (), holds: tuple[str, ...] = (), ends: str = "", base: str = "", least: int = 1, digits: bool = True, once: bool = False, slug: Column | None = None, page: Column | None = None) -> Column:
    """[(title, link)] of a page's anchors that a site's rule takes, in order.

    A link starts with one of ``starts``, holds all of ``holds`` and ``slug``, ends with ``ends`` and isn't the ``page`` itself; a title has
    at least ``least`` characters and, without ``digits``, isn't a number. Relative links get ``base``; with ``once`` a link's first anchor counts.
    """
    anchor = F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all(html, anchor, 2).alias("title"), F.regexp_extract_all(html, anchor, 1).alias("link"))
    pairs = F.transform(pairs, lambda x: F.struct(strip(F.regexp_replace(x["title"], r"<[^>]+>", "")).alias("title"), x["link"].alias("link")))

    def taken(x: Column) -> Column:
        link, ok = x["link"], F.length(x["title"]) >= least
        if starts:
            begins = F.lit(False)
            for s in starts:
                begins = begins | link.startswith(s)
            ok = ok & begins
        for h in holds:
            ok = ok & link.contains(h)
        ok = ok & link.endswith(ends) if ends else ok
        ok = ok & ~x["title"].rlike(r"^\d+$") if not digits else ok
        ok = ok & F.contains(link, slug) if slug is not None else ok
        return ok & (link != page) if page is not None else ok

    out = F.filter(pairs, taken)
    if base:
        out = F.transform(out, lambda x: F.struct(x["title"].alias("title"), F.when(x["link"].startswith("http"), x["link"]).otherwise(F.concat(F.lit(base), x["link"])).alias("link")))
    if once:
        links = F.transform(out, lambda x: x["link"])
        out = F.filter(out, lambda x, i: F.array_position(links, x["link"]) == i + 1)
    return out


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)
