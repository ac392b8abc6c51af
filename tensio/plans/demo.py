"""Parameters that make the dictionary-driven queries non-vacuous on the test tables.

The reference's own dictionaries barely occur in the synthetic multilingual prose of the
test tables (no stress term at all; relevance never reaches 0.5).  The queries therefore
run each dictionary operator twice: with the reference dictionaries, and with the
parameters below, which are ordinary user inputs of the same operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensio.functions.lexicons import DEFAULT_FAMILIES, ScoreProfile

# Three term families matched as substrings of the cleaned text, weighted like the
# reference's effective weights (0.30 / 0.20 / 0.50).
DEMO_FAMILIES = {
    "a": ["test", "bet", "teacher", "ndth"],
    "b": ["exam", "estt", "tea"],
    "c": ["teen", "tee", "shan"],
}
DEMO_PROFILE = ScoreProfile(DEMO_FAMILIES, {"a": 0.30, "b": 0.20, "c": 0.50}, threshold=0.5, name="demo")

# The reference dictionaries and effective weights with a lower cut (the reference's 0.5
# keeps nothing on this data).
V2_AT_025 = ScoreProfile(
    DEFAULT_FAMILIES, {"stress": 0.30, "educational": 0.20, "age": 0.50, "slang": 0.0}, threshold=0.25, name="v2@0.25"
)

# Function words of the four languages; "de" and "la" sit in two topics on purpose.
DEMO_TOPICS = {
    "english": ["the", "of", "and", "to"],
    "french": ["le", "la", "les", "de"],
    "spanish": ["de", "la", "el", "que"],
    "german": ["der", "die", "und", "das"],
}
DEMO_TOPIC_LABELS: dict[str, str] = {}

# (word, polarity, subjectivity)
DEMO_LEXICON = [
    ("the", 0.3, 0.4),
    ("of", -0.4, 0.6),
    ("and", 0.1, 0.2),
    ("de", -0.2, 0.3),
    ("la", 0.5, 0.9),
    ("der", -0.6, 0.7),
    ("en", -0.1, 0.1),
    ("is", 0.6, 0.5),
]


def demo_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_LEXICON, "word string, polarity double, subjectivity double")
