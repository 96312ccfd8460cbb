"""Settings with defaults, and the small fixed relations that routing and speech need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
CAPABILITIES = "candidate_discovery candidate_triage text_scoring final_judgment duplicate_risk".split()
LANGUAGES = [("en", "English", "en-US"), ("hi", "Hindi", "hi-IN"), ("auto", "Other", "multi")]
SPEECH = [("en", 0, "english", True), ("en", 1, "english_backup", True), ("hi", 0, "multilingual", False), ("auto", 0, "multilingual", False)]


def with_defaults(json: Column, defaults: dict[str, str]) -> Column:
    """A map of settings from a JSON text laid over defaults; an unreadable or missing text gives the defaults."""
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    own = F.coalesce(F.from_json(json, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(own, lambda k, v: v.isNotNull() & k.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, label string, code string")


def speech_models(spark: SparkSession) -> DataFrame:
    """Kinds of speech models for a language, best first: language, place, model, word_times."""
    return spark.createDataFrame(SPEECH, "language string, place int, model string, word_times boolean")


def language_code(language: Column) -> Column:
    """The code for the speech service; an unknown language counts as other."""
    return F.when(language == "en", "en-US").when(language == "hi", "hi-IN").otherwise("multi")
