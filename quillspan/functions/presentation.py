"""What a creator reads: explanations, reasons, post texts, tagged lines, sizes and styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.numbers import clamp, half_up
from quillspan.functions.text import content_words

#: Our wording of a strong dimension.
REASONS = {
    "hook": "Strong opening seconds", "payoff": "Pays off", "retention": "Keeps its grip", "context": "Needs no background",
    "completeness": "Complete in itself", "emotion": "Moving", "curiosity": "Raises a question", "quotability": "Has a line to quote",
    "surprise": "Takes a turn", "storytelling": "Tells a story", "usefulness": "Useful", "opening": "Clean start", "ending": "Strong last line",
}
LOUD_REASON, FILLER_REASON = "Loud, lively moment", "Filler: too few strong moments"


def tagged(index: Column, text: Column, mark: str = "") -> Column:
    """[12]text, or [s12] text for sentences."""
    return F.concat(F.lit(f"[{mark}"), index.cast("string"), F.lit("] " if mark else "]"), text)


def explain(quality: Column, tier: Column, penalties: Column) -> Column:
    """Quality and tier, then the penalties above zero by name."""
    costly = F.array_sort(F.filter(F.map_entries(penalties), lambda e: e["value"] > 0))
    parts = F.transform(costly, lambda e: F.concat(F.lit("-"), F.format_number(e["value"], 2), F.lit(" "), e["key"]))
    head = F.concat(F.lit("quality "), F.format_number(quality, 2), F.lit(" ("), tier, F.lit(")"))
    return F.array_join(F.concat(F.array(head), parts), ", ")


def reasons(energy: Column, dims: Column, source: Column, most: int = 4) -> Column:
    """Loudness first, then dimensions of 7 and more, strongest first; fillers say so."""
    names = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    order = F.array(*(F.lit(k) for k in REASONS))
    strong = F.filter(F.map_entries(dims), lambda e: (e["value"] >= 7) & names[e["key"]].isNotNull())
    ranked = F.array_sort(F.transform(strong, lambda e: F.struct((-e["value"]).alias("v"), F.array_position(order, e["key"]).alias("k"), e["key"].alias("name"))))
    loud = F.when(energy >= 0.5, F.array(F.lit(LOUD_REASON))).otherwise(F.expr("cast(array() as array<string>)"))
    all_reasons = F.slice(F.concat(F.coalesce(loud, F.expr("cast(array() as array<string>)")), F.transform(F.coalesce(ranked, F.slice(ranked, 1, 0)), lambda r: names[r["name"]])), 1, most)
    return F.when((F.size(all_reasons) <= 0) & (source == "fallback"), F.array(F.lit(FILLER_REASON))).otherwise(all_reasons)


def hashtags(topic: Column, title: Column, content_type: Column, most: int = 6) -> Column:
    """Up to three content words, two tags of the kind of content, and the general one; distinct, in order."""
    words = F.slice(content_words(F.concat_ws(" ", topic, title)), 1, 3)
    base = F.when(content_type.isin("gaming", "stream"), F.array(F.lit("gaming"), F.lit("streamer"))).otherwise(F.array(F.lit("podcast"), F.lit("clips")))
    tags = F.transform(F.concat(words, base, F.array(F.lit("shorts"))), lambda w: F.concat(F.lit("#"), F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: F.length(t) > 1)), 1, most)


def post_caption(hook: Column, title: Column, limit: int = 200) -> Column:
    quoted = F.concat(F.lit('"'), F.trim(F.regexp_replace(hook, '["“”]', "")), F.lit('"'))
    return F.substring(F.concat_ws(" · ", quoted, F.when(title != "", title)), 1, limit)


def bytes_label(n: Column) -> Column:
    """1.5 GB, 20 MB, 3 KB."""
    return (
        F.when(n >= 1e9, F.concat(F.format_number(n / 1e9, 1), F.lit(" GB"))).when(n >= 1e6, F.concat(half_up(n / 1e6).cast("int").cast("string"), F.lit(" MB")))
        .otherwise(F.concat(half_up(n / 1e3).cast("int").cast("string"), F.lit(" KB")))
    )


def style(preset: Column, override: Column) -> Column:
    """A caption style: the preset's fields unless overridden; the size factor is kept between 0.7 and 1.5.

    Both are structs with font, color, accent, size and margin; override's size is a factor and its position (top, middle) sets the margin.
    A preset without an accent never gets one.
    """
    pick = lambda name: F.coalesce(override[name], preset[name]).alias(name)
    size = preset["size"] * clamp(F.coalesce(override["size"], F.lit(1.0)), 0.7, 1.5)
    margin = F.when(override["position"] == "top", 0.8).when(override["position"] == "middle", 0.42).otherwise(preset["margin"])
    accent = F.when(preset["accent"].isNotNull(), F.coalesce(override["accent"], preset["accent"]))
    return F.struct(pick("font"), pick("color"), accent.alias("accent"), size.alias("size"), margin.alias("margin"))


def ago(seconds: Column) -> Column:
    """just now, 5 min ago, 3 h ago, 2 d ago."""
    part = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {name} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "min")).when(seconds < 86_400, part(3600, "h")).otherwise(part(86_400, "d"))


def notes(parts: Column) -> Column:
    """Distinct notes in order, joined."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda n: n != "")), "; ")
