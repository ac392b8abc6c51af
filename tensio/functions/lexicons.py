"""Dictionaries, weights and tokens that results depend on.

Dictionaries are data: every operator takes them as parameters and these are only the
defaults.  A dictionary is an ordered mapping ``family -> [term, ...]``; the order of the
terms is the order in which found terms are listed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------
# FIXED VALUES — must equal the reference for equal results; natural order, unchanged.
# ---------------------------------------------------------------------------------------

# Term families matched as substrings of the cleaned text.
STRESS_TERMS = [
    "stress", "anxiety", "depression", "worried", "nervous",
    "panic", "tension", "pressure", "overwhelm", "burnout",
    "mental health", "emotional", "exhausted", "tired",
]
EDUCATIONAL_TERMS = [
    "school", "college", "university", "exam", "test",
    "homework", "study", "class", "grade", "assignment",
    "teacher", "professor", "student", "education",
]
AGE_TERMS = ["teen", "teenage", "adolescent"]
SLANG_TERMS = [
    "lit", "fam", "salty", "slay", "tea",
    "sus", "ghosting", "flex", "shade", "vibe",
    "bet", "lowkey", "highkey", "on fleek", "woke",
    "savage", "bae", "dope", "snatched", "no cap",
]

# Relevance: each family contributes min(matches / 2, 1) * weight; the total is rounded to
# 3 places and kept when >= 0.5.  The reference's fourth component reuses the age count,
# so the effective weights are stress 0.30, educational 0.20, age 0.30 + 0.20, slang 0.
RELEVANCE_THRESHOLD = 0.5
MATCH_SATURATION = 2.0
SCORE_ROUND_DIGITS = 3

# Topic keywords, matched as whole lowercase word tokens (a word may sit in two topics).
TOPIC_KEYWORDS = {
    "academic": [
        "exam", "test", "study", "homework", "grade", "school", "class",
        "teacher", "assignment", "quiz", "report", "project", "gpa",
        "semester", "final", "subject", "math", "science", "essay",
        "tutor", "academic", "learning", "education", "classroom",
    ],
    "social_peer": [
        "friend", "friends", "party", "hangout", "social", "peer",
        "relationship", "group", "team", "peer-pressure", "best friend",
        "drama", "trust", "support", "loneliness",
    ],
    "extracurricular": [
        "sports", "club", "activity", "extracurricular", "hobby",
        "interest", "volunteer", "practice", "team", "competition",
        "performing", "creativity", "art", "music", "dance",
    ],
    "future_career": [
        "career", "job", "internship", "future", "resume", "interview",
        "experience", "skills", "networking", "professional",
        "education", "goals", "dream", "ambition",
    ],
}
TOPIC_LABELS = {
    "academic": "School & Studies",
    "social_peer": "Friends & Social Life",
    "extracurricular": "Activities & Sports",
    "future_career": "Career & Future",
}

# Weak sentiment classes and the classifier's class weights.
CLASS_NAMES = ["Positive", "Neutral", "Negative"]  # class ids 0, 1, 2
CLASS_WEIGHTS = {0: 1.0, 1: 1.0, 2: 1.2}
POLARITY_MARGIN = 0.1
SUBJECTIVITY_CUT = 0.5
MIN_SAMPLES_PER_CLASS = 10
MIN_TEXT_LENGTH = 10  # texts must be strictly longer
RANDOM_SEED = 42
TEST_FRACTION = 0.2

# Sequence encoding.
MAX_WORDS = 100000
MAX_LEN = 150
KERAS_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# Tokens read as missing (pandas' default NA strings plus the empty string).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Sentinel replaced by the empty string in the query column.
NO_QUERY = "NO_QUERY"

# The positive / negative source labels of the Sentiment140 layout.
SENTIMENT140_MAP = {0: 0, 4: 1}

# ---------------------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------------------

DEFAULT_FAMILIES = {
    "stress": STRESS_TERMS,
    "educational": EDUCATIONAL_TERMS,
    "age": AGE_TERMS,
    "slang": SLANG_TERMS,
}


@dataclass(frozen=True)
class ScoreProfile:
    """Term families plus the weight each family's saturated match count gets."""

    families: dict[str, list[str]]
    weights: dict[str, float]
    threshold: float = RELEVANCE_THRESHOLD
    saturation: float = MATCH_SATURATION
    digits: int = SCORE_ROUND_DIGITS
    name: str = field(default="custom")

    def with_threshold(self, threshold: float) -> "ScoreProfile":
        return ScoreProfile(self.families, self.weights, threshold, self.saturation, self.digits, self.name)


# The weights the current cleaning code applies (slang's share goes to the age count).
PROFILE_V2 = ScoreProfile(
    DEFAULT_FAMILIES, {"stress": 0.30, "educational": 0.20, "age": 0.50, "slang": 0.0}, name="v2"
)
# The weights that reproduce the shipped Sentiment140 sample.
PROFILE_V1 = ScoreProfile(
    DEFAULT_FAMILIES, {"stress": 0.30, "educational": 0.30, "age": 0.40, "slang": 0.0}, name="v1"
)
