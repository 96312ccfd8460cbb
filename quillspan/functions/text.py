"""Text predicates and renderings as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence or a clause, and what may close after them.
SENTENCE_END = r"[.!?…।]+[\"'”’)\]]*$"
CLAUSE_END = r"[.!?…।,;:—–]+[\"'”’)\]]*$"
BLANKS = r"[ \t\n\r\f\x0B]+"
NO_BLANK = r"[^ \t\n\r\f\x0B]"

#: Words without content, English and Hindi in Latin letters.
STOPWORDS = (
    "a an the and or but if then so to of in on at for with from by as is are was were "
    "be been being it its this that these those i you he she we they me him her us them "
    "my your his our their what which who whom when where why how all any both each few "
    "more most other some such no nor not only own same than too very can will just don "
    "should now do does did doing have has had having would could there here about into "
    "over under again further once up down out off like yeah um uh oh okay ok really "
    "know think mean gonna got get going right well also even still because thing things "
    "lot kind sort hai ka ki ke ko se me mein ye yeh wo woh aur bhi toh to na nahi kya"
).split()


#: Lower-case letters with marks, by decomposition, and the letters without them.
_MARKED = {
    c: bare
    for c in map(chr, range(0xE0, 0x1F00))
    if (bare := unicodedata.normalize("NFKD", c)[0]) != c and bare.isascii() and bare.isalnum() and c.islower()
}
MARKED, BARE = "".join(_MARKED), "".join(_MARKED.values())


def tokens(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ends_sentence(word: Column) -> Column:
    return F.trim(word).rlike(SENTENCE_END)


def ends_clause(word: Column) -> Column:
    return F.trim(word).rlike(CLAUSE_END)


def content_words(text: Column) -> Column:
    """Distinct lower-cased words of over two characters that are no stopwords, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_distinct(F.array_except(long, F.array(*(F.lit(w) for w in STOPWORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty, null if either is null."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def sentence_ref(value: Column) -> Column:
    """12, "12" or "s12" as a number; anything else is null."""
    return F.regexp_extract(value, r"(?i)^\s*s?(\d+)\s*$", 1).try_cast("int")


def strip_reasoning(reply: Column) -> Column:
    """A reply without its thinking blocks, closed or only ended."""
    paired = F.regexp_replace(reply, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(paired, r"(?is)^.*?</think(?:ing)?>", ""))


def clock_srt(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    part = lambda unit, of: F.floor(ms / unit) % of
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def clock_label(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def srt_to_vtt(srt: Column) -> Column:
    plain = F.regexp_replace(F.replace(srt, F.lit("\r"), F.lit("")), r"(\d{2}:\d{2}:\d{2}),(\d{3})", "$1.$2")
    return F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace(plain, r"(?m)^\d+\n(?=\d{2}:)", ""))


def slug(name: Column, fallback: str = "clip", limit: int = 40) -> Column:
    """Lower-case letters and digits with dashes between, for file names; letters with marks count without them."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), MARKED, BARE)
    s = F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, limit)
    return F.when(s == "", fallback).otherwise(s)


def head_and_tail(text: Column, limit: int = 1320, head: int = 900, tail: int = 400) -> Column:
    """Beginning and end of a long text."""
    cut = F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def stock_phrase(text: Column, phrases: list[str]) -> Column:
    """Empty where the whole text is one of the phrases (case and closing marks apart)."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[.!?,]+$", "")
    return F.when(bare.isin([p.lower() for p in phrases]), "").otherwise(text)
