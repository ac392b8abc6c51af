"""DuckDB SQL equal to each query of ``tensio.plans.catalog`` (the correctness oracle).

Tables are pre-registered views named after the Parquet files.  The SQL is generated from
the same dictionaries and parameters the Spark side uses, so both state one recipe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tensio.functions import text as T
from tensio.functions.lexicons import (
    MAX_LEN,
    MAX_WORDS,
    NA_TOKENS,
    PROFILE_V2,
    RANDOM_SEED,
    TOPIC_KEYWORDS,
    TOPIC_LABELS,
    ScoreProfile,
)
from tensio.plans.demo import DEMO_LEXICON, DEMO_PROFILE, DEMO_TOPIC_LABELS, DEMO_TOPICS, V2_AT_025


def round_sql(x: str, digits: int) -> str:
    """Correctly rounded from the exact binary value, ties to even (as Python's round)."""
    return f"printf('%.{digits}f', {x})::DOUBLE"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(x: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce("
        f"{x}, '')), {q(T.URL_RE)}, '', 'g'), {q(T.NON_LETTER_RE)}, '', 'g'), {q(T.WS_RUN_RE)}, ' ', 'g'))"
    )


def count_sql(t: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({t}, {q(w)})::INTEGER" for w in terms) + ")"


def found_sql(t: str, terms: Sequence[str]) -> str:
    cases = ", ".join(f"CASE WHEN contains({t}, {q(w)}) THEN {q(w)} END" for w in terms)
    return f"CASE WHEN concat_ws(', ', {cases}) = '' THEN 'none' ELSE concat_ws(', ', {cases}) END"


def score_sql(t: str, profile: ScoreProfile, counts: Mapping[str, str] | None = None) -> str:
    parts = []
    for fam, w in profile.weights.items():
        if w == 0:
            continue
        n = counts[fam] if counts else count_sql(t, profile.families[fam])
        parts.append(f"least({n}::DOUBLE / {profile.saturation}::DOUBLE, 1.0::DOUBLE) * {float(w)}::DOUBLE")
    total = " + ".join(parts) if parts else "0.0::DOUBLE"
    return f"CASE WHEN {t} = '' THEN 0.0::DOUBLE ELSE {round_sql(total, profile.digits)} END"


WORD_RE_SQL = q(T.WORD_RE)


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {WORD_RE_SQL}, 0)"


DEDUPED_DOCS = "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"


def _cleaned_flow(profile: ScoreProfile) -> str:
    fams = list(profile.families)
    counts = ", ".join(f"{count_sql('cleaned_text', profile.families[f])} AS {f}_term_count" for f in fams)
    found = ", ".join(f"{found_sql('cleaned_text', profile.families[f])} AS {f}_terms_found" for f in fams)
    score = score_sql("cleaned_text", profile, {f: f"{f}_term_count" for f in fams})
    return f"""
d AS ({DEDUPED_DOCS}),
c AS (SELECT d.*, {clean_sql('text')} AS cleaned_text FROM d),
n AS (SELECT c.*, {counts} FROM c),
s AS (SELECT n.*, {score} AS relevance_score FROM n),
kept AS (SELECT s.*, {found} FROM s WHERE relevance_score >= {float(profile.threshold)}::DOUBLE)"""


def clean_dataset_sql(profile: ScoreProfile) -> str:
    fams = list(profile.families)
    cols = ", ".join(
        ["doc_id", "text", "lang", "source", "n_chars", "cleaned_text", "relevance_score"]
        + [f"{f}_terms_found" for f in fams]
        + [f"{f}_term_count" for f in fams]
    )
    return f"WITH {_cleaned_flow(profile)}\nSELECT {cols} FROM kept"


CORPUS = f"""corpus AS (
  SELECT doc_id, cleaned_text FROM (SELECT doc_id, {clean_sql('text')} AS cleaned_text FROM documents)
  WHERE length(cleaned_text) > 10
  QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY doc_id) = 1)"""

# lexicon values in integer micro-units, as the Spark side takes them
LEXICON = "lex(word, pu, su) AS (VALUES " + ", ".join(
    f"({q(w)}, {int(round(p * 1_000_000))}::BIGINT, {int(round(s * 1_000_000))}::BIGINT)" for w, p, s in DEMO_LEXICON
) + ")"


def mean_micro_sql(total: str, n: str) -> str:
    """Exact integer mean rounded half away from zero, as a double in units."""
    return (
        f"(CASE WHEN {total} >= 0 THEN (2 * {total} + {n}) // (2 * {n}) "
        f"ELSE -((-2 * {total} + {n}) // (2 * {n})) END)::DOUBLE / 1000000.0::DOUBLE"
    )


LABELLED = f"""{CORPUS},
{LEXICON},
tok AS (SELECT doc_id, unnest(string_split(cleaned_text, ' ')) AS word FROM corpus),
sums AS (SELECT doc_id, sum(pu) AS sp, sum(su) AS ss, count(*) AS n FROM tok JOIN lex USING (word) GROUP BY doc_id),
hits AS (SELECT doc_id, {mean_micro_sql("sp", "n")} AS polarity, {mean_micro_sql("ss", "n")} AS subjectivity,
         n::INTEGER AS lexicon_hits FROM sums),
lab0 AS (SELECT c.doc_id, c.cleaned_text, coalesce(h.polarity, 0.0::DOUBLE) AS polarity,
         coalesce(h.subjectivity, 0.0::DOUBLE) AS subjectivity, coalesce(h.lexicon_hits, 0)::INTEGER AS lexicon_hits
         FROM corpus c LEFT JOIN hits h USING (doc_id)),
labelled AS (SELECT *, CASE WHEN polarity > 0.1::DOUBLE THEN 0 WHEN polarity < -0.1::DOUBLE THEN 2
             WHEN subjectivity < 0.5::DOUBLE AND polarity <= 0.0::DOUBLE THEN 2 ELSE 1 END AS sentiment FROM lab0)"""

BALANCED = f"""{LABELLED},
cnt AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment),
plan AS (SELECT sentiment, n, greatest(floor(median(n) OVER ()), 10)::BIGINT AS target FROM cnt),
plan2 AS (SELECT sentiment, target, ceil(target / n)::INTEGER AS copies FROM plan),
rep AS (SELECT l.doc_id, l.cleaned_text, l.sentiment, p.target, unnest(generate_series(1, p.copies)) AS replica
        FROM labelled l JOIN plan2 p USING (sentiment)),
balanced AS (SELECT doc_id, cleaned_text, sentiment, replica::INTEGER AS replica,
             doc_id::VARCHAR || ':' || replica::VARCHAR AS row_key FROM rep
             QUALIFY row_number() OVER (PARTITION BY sentiment
                     ORDER BY md5('{RANDOM_SEED}:' || doc_id::VARCHAR || ':' || replica::VARCHAR), doc_id, replica) <= target)"""

def split_ctes(source: str, label: str, key: str) -> str:
    """Stratified 20 % split of ``source`` as CTEs ending in ``split``; a NULL label is a stratum."""
    return f"""sc AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label}),
s1 AS (SELECT {label}, n, sum(n) OVER () AS tot FROM sc),
s2 AS (SELECT *, ceil(0.2::DOUBLE * tot) AS n_test FROM s1),
s3 AS (SELECT *, tot - n_test AS n_train FROM s2),
s4 AS (SELECT *, (n / tot) * n_train AS cont FROM s3),
s5 AS (SELECT *, floor(cont) AS fl FROM s4),
s6 AS (SELECT *, n_train - sum(fl) OVER () AS need FROM s5),
s7 AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, {label} NULLS FIRST) AS rk FROM s6),
sizes AS (SELECT {label}, (n - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END))::BIGINT AS test_n FROM s7),
split AS (SELECT b.{key}, b.{label},
          CASE WHEN row_number() OVER (PARTITION BY b.{label} ORDER BY md5('{RANDOM_SEED}:' || b.{key}::VARCHAR), b.{key}) <= s.test_n
               THEN 'test' ELSE 'train' END AS fold
          FROM {source} b JOIN sizes s ON b.{label} IS NOT DISTINCT FROM s.{label})"""


SPLIT = f"""{BALANCED},
{split_ctes("balanced", "sentiment", "row_key")}"""

STANDIN = [(31, 7), (57, 3), (89, 11)]


def standin_sql(key: str) -> str:
    a = [f"(({key} * {m} + {b}) % 97 + 1)" for m, b in STANDIN]
    tot = f"({a[0]} + {a[1]} + {a[2]})"
    return ", ".join(f"{a[i]} / {tot} AS p{i}" for i in range(3))


PRED_COLS = """CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS "Predicted_Sentiment",
  greatest(p0, p1, p2) AS "Confidence_Score", p0 AS "Positive_Probability", p1 AS "Neutral_Probability",
  p2 AS "Negative_Probability\""""

PREDICTED = f"""{BALANCED},
pp AS (SELECT b.*, {standin_sql('doc_id')} FROM balanced b),
predictions AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted FROM pp)"""


def _platform_corpus(table: str, k1: str, k2: str) -> str:
    return f"""(SELECT k1, k2, cleaned_text FROM (SELECT {k1} AS k1, {k2} AS k2, {clean_sql('text')} AS cleaned_text FROM {table})
   WHERE length(cleaned_text) > 10 QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY k1, k2) = 1)"""


PLATFORM_RECORDS = f"""pd AS {_platform_corpus('documents', 'doc_id', '0::BIGINT')},
pc AS {_platform_corpus('conversations', 'conv_id', 'turn')},
pb AS {_platform_corpus('benchmark', 'item_id', '0::BIGINT')},
ppd AS (SELECT cleaned_text, {standin_sql('k1')} FROM pd),
ppc AS (SELECT cleaned_text, {standin_sql('(k1 * 1000 + k2)')} FROM pc),
ppb AS (SELECT cleaned_text, {standin_sql('k1')} FROM pb),
recs AS (SELECT cleaned_text AS "Text", {PRED_COLS}, 'documents' AS "Platform" FROM ppd
         UNION ALL
         SELECT cleaned_text AS "Text", {PRED_COLS}, 'conversations' AS "Platform" FROM ppc
         UNION ALL
         SELECT cleaned_text AS "Text", {PRED_COLS}, 'benchmark' AS "Platform" FROM ppb)"""


def topic_share_sql(
    topics: Mapping[str, Sequence[str]], labels: Mapping[str, str], source: str = "documents", prefix: str = ""
) -> str:
    kw = ", ".join(
        f"({q(t)}, {pos}, {q(w)})" for pos, (t, ws) in enumerate(topics.items()) for w in dict.fromkeys(ws)
    )
    tp = ", ".join(
        f"({q(t)}, {pos}, {q(labels[t]) if t in labels else 'NULL'})" for pos, t in enumerate(topics)
    )
    return f"""
WITH {prefix}kw(topic, topic_pos, keyword) AS (VALUES {kw}),
tp(topic, topic_pos, display_name) AS (VALUES {tp}),
topic_tok AS (SELECT unnest({tokens_sql('text')}) AS token FROM {source}),
topic_hits AS (SELECT kw.topic, count(*) AS hits FROM topic_tok JOIN kw ON topic_tok.token = kw.keyword GROUP BY kw.topic),
j AS (SELECT tp.topic, coalesce(tp.display_name, tp.topic) AS label, coalesce(topic_hits.hits, 0) AS hits
      FROM tp LEFT JOIN topic_hits USING (topic)),
t AS (SELECT *, sum(hits) OVER () AS total FROM j),
p AS (SELECT topic, label, hits::BIGINT AS hits, CASE WHEN total > 0 THEN (hits / total) * 100.0::DOUBLE END AS pct FROM t)
SELECT topic, label, hits, pct, label || chr(10) || '(' || printf('%.1f', pct) || '%)' AS display FROM p
"""


def keyword_counts_sql(topics: Mapping[str, Sequence[str]]) -> str:
    kw = ", ".join(f"({q(t)}, {q(w)})" for t, ws in topics.items() for w in dict.fromkeys(ws))
    return f"""
WITH kw(topic, keyword) AS (VALUES {kw}),
tok AS (SELECT unnest({tokens_sql('text')}) AS token FROM documents)
SELECT kw.topic, kw.keyword, count(*) AS hits FROM tok JOIN kw ON tok.token = kw.keyword GROUP BY kw.topic, kw.keyword
"""


def _report_sql() -> str:
    def ratio(num: str, den: str) -> str:
        return f"CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den})::DOUBLE ELSE 0.0::DOUBLE END"

    names = ["Positive", "Neutral", "Negative"]
    aggs = []
    for c in range(3):
        aggs += [
            f"count_if(sentiment = {c} AND predicted = {c}) AS tp{c}",
            f"count_if(sentiment <> {c} AND predicted = {c}) AS fp{c}",
            f"count_if(sentiment = {c} AND predicted <> {c}) AS fn{c}",
        ]
    aggs.append("count(*) AS total")
    p = [ratio(f"tp{c}", f"tp{c} + fp{c}") for c in range(3)]
    r = [ratio(f"tp{c}", f"tp{c} + fn{c}") for c in range(3)]
    f = [ratio(f"2 * tp{c}", f"2 * tp{c} + fp{c} + fn{c}") for c in range(3)]
    s = [f"(tp{c} + fn{c})" for c in range(3)]

    def mean(v):
        return f"(({v[0]}) + ({v[1]}) + ({v[2]})) / 3.0::DOUBLE"

    def weighted(v):
        return ratio(f"({v[0]}) * {s[0]} + ({v[1]}) * {s[1]} + ({v[2]}) * {s[2]}", "total")

    rows = [f"SELECT {q(names[c])} AS label, {p[c]} AS precision, {r[c]} AS recall, {f[c]} AS f1_score, {s[c]}::BIGINT AS support FROM cm" for c in range(3)]
    rows.append(f"SELECT 'accuracy', NULL::DOUBLE, NULL::DOUBLE, {ratio('tp0 + tp1 + tp2', 'total')}, total::BIGINT FROM cm")
    rows.append(f"SELECT 'macro avg', {mean(p)}, {mean(r)}, {mean(f)}, total::BIGINT FROM cm")
    rows.append(f"SELECT 'weighted avg', {weighted(p)}, {weighted(r)}, {weighted(f)}, total::BIGINT FROM cm")
    union = "\n  UNION ALL ".join(rows)
    return f"""WITH {PREDICTED},
cm AS (SELECT {', '.join(aggs)} FROM predictions),
report AS ({union})
SELECT label, {round_sql("precision", 6)} AS precision, {round_sql("recall", 6)} AS recall,
  {round_sql("f1_score", 6)} AS f1_score, support FROM report"""


def _family_cols(t: str, profile: ScoreProfile, kind: str) -> str:
    if kind == "found":
        return ", ".join(f"{found_sql(t, ws)} AS {f}_terms_found" for f, ws in profile.families.items())
    return ", ".join(f"{count_sql(t, ws)} AS {f}_term_count" for f, ws in profile.families.items())


CLEANED_DOCS = f"(SELECT doc_id, {clean_sql('text')} AS t FROM documents)"
NA_LIST = ", ".join(q(t) for t in NA_TOKENS)
DOCS_WITH_LABEL = "(SELECT d.doc_id, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id))"


def vocab_ctes(max_words: int) -> str:
    return f"""{CORPUS},
words AS (SELECT unnest(string_split(cleaned_text, ' ')) AS word FROM corpus),
wc AS (SELECT word, count(*) AS count FROM words WHERE word <> '' GROUP BY word),
vocab AS (SELECT word, count, row_number() OVER (ORDER BY count DESC, word)::INTEGER AS id FROM wc
          QUALIFY row_number() OVER (ORDER BY count DESC, word) <= {max_words - 1})"""


VOCAB = vocab_ctes(MAX_WORDS)
SEQUENCES = f"""{VOCAB},
tp AS (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS pos
       FROM (SELECT doc_id, string_split(cleaned_text, ' ') AS s FROM corpus)),
ids AS (SELECT tp.doc_id, tp.pos, v.id FROM tp JOIN vocab v ON tp.word = v.word),
seqs AS (SELECT c.doc_id, list(ids.id ORDER BY ids.pos) FILTER (WHERE ids.id IS NOT NULL) AS idl
         FROM corpus c LEFT JOIN ids USING (doc_id) GROUP BY c.doc_id)"""


LARGE_LEXICON = f"""{CORPUS},
tok AS (SELECT doc_id, unnest(string_split(cleaned_text, ' ')) AS word FROM corpus),
entries AS (SELECT word, (length(word) * 7 % 21 - 10) * 100000 AS pu, length(word) % 11 * 100000 AS su FROM (SELECT DISTINCT word FROM tok)
            UNION ALL SELECT word, (length(word) * 7 % 21 - 10) * 100000 + 500000, 0 FROM (SELECT DISTINCT word FROM tok) WHERE length(word) % 3 = 0),
lex AS (SELECT word, pu, su FROM entries QUALIFY row_number() OVER (PARTITION BY word ORDER BY pu, su) = 1),
sums AS (SELECT doc_id, sum(pu)::BIGINT AS sp, sum(su)::BIGINT AS ss, count(*) AS n FROM tok JOIN lex USING (word) GROUP BY doc_id)
SELECT doc_id, {mean_micro_sql("sp", "n")} AS polarity, {mean_micro_sql("ss", "n")} AS subjectivity, n::INTEGER AS lexicon_hits FROM sums"""

CLASSIFIER_CHECKS = f"""WITH {LABELLED},
{split_ctes("labelled", "sentiment", "doc_id")},
trained AS (SELECT sentiment, count(*) AS n FROM split WHERE fold = 'train' GROUP BY sentiment),
resized AS (SELECT (greatest(floor(median(n)), 10) * count(*))::BIGINT AS rows FROM trained),
held AS (SELECT count(*) AS rows FROM split WHERE fold = 'test')
SELECT resized.rows + held.rows AS scored_rows, held.rows AS test_rows, 0::BIGINT AS wrong_sums, 0::BIGINT AS wrong_argmax,
  true AS beats_majority FROM resized, held"""

PLATFORM_CORPORA = " UNION ALL ".join(
    f"SELECT '{name}' AS platform, concat_ws(':', '{name}', k1::VARCHAR, k2::VARCHAR) AS key, cleaned_text FROM {_platform_corpus(name, k1, k2)}"
    for name, k1, k2 in (("documents", "doc_id", "0::BIGINT"), ("conversations", "conv_id", "turn"), ("benchmark", "item_id", "0::BIGINT"))
)
#: Rows that each platform's model must have been trained and tested on; the rest must hold of any model.
PLATFORM_MODELS = f"""WITH corpus AS ({PLATFORM_CORPORA}),
{LEXICON},
tok AS (SELECT key, unnest(string_split(cleaned_text, ' ')) AS word FROM corpus),
sums AS (SELECT key, sum(pu) AS sp, sum(su) AS ss, count(*) AS n FROM tok JOIN lex USING (word) GROUP BY key),
scored AS (SELECT c.platform, c.key, coalesce({mean_micro_sql("sp", "n")}, 0.0::DOUBLE) AS polarity, coalesce({mean_micro_sql("ss", "n")}, 0.0::DOUBLE) AS subjectivity
           FROM corpus c LEFT JOIN sums USING (key)),
labelled AS (SELECT platform, CASE WHEN polarity > 0.1::DOUBLE THEN 0 WHEN polarity < -0.1::DOUBLE THEN 2
             WHEN subjectivity < 0.5::DOUBLE AND polarity <= 0.0::DOUBLE THEN 2 ELSE 1 END AS sentiment FROM scored),
sc AS (SELECT platform, sentiment, count(*) AS n FROM labelled GROUP BY ALL),
s1 AS (SELECT *, sum(n) OVER (PARTITION BY platform) AS tot FROM sc),
s2 AS (SELECT *, tot - ceil(0.2::DOUBLE * tot) AS n_train FROM s1),
s3 AS (SELECT *, (n / tot) * n_train AS cont, floor((n / tot) * n_train) AS fl FROM s2),
s4 AS (SELECT *, n_train - sum(fl) OVER (PARTITION BY platform) AS need, row_number() OVER (PARTITION BY platform ORDER BY cont - fl DESC, sentiment) AS rk FROM s3),
sizes AS (SELECT platform, n, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS train FROM s4)
SELECT platform, (greatest(floor(median(train) FILTER (train > 0)), 10) * count(*) FILTER (train > 0))::BIGINT AS trained_rows,
  sum(n - train)::BIGINT AS test_rows, 0::BIGINT AS wrong_sums, 0::BIGINT AS wrong_argmax, true AS within_budget, true AS best_kept
FROM sizes GROUP BY platform"""

ORACLE: dict[str, str] = {
    "platform_models": PLATFORM_MODELS,
    "keyword_bag": f"""WITH kw(topic, keyword) AS (VALUES {", ".join(f"({q(t)}, {q(w)})" for t, ws in DEMO_TOPICS.items() for w in dict.fromkeys(ws))}),
tok AS (SELECT doc_id, unnest(s) AS token, generate_subscripts(s, 1) AS place FROM (SELECT doc_id, {tokens_sql('text')} AS s FROM documents))
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY doc_id, place) AS ordinal, keyword FROM tok JOIN kw ON token = keyword""",
    "describe_prices": f"""SELECT count(l_extendedprice) AS count, {round_sql("avg(l_extendedprice::DOUBLE)", 4)} AS mean, {round_sql("stddev_samp(l_extendedprice::DOUBLE)", 4)} AS std,
  min(l_extendedprice)::DOUBLE AS min, {round_sql("quantile_cont(l_extendedprice::DOUBLE, 0.25)", 4)} AS p25, {round_sql("quantile_cont(l_extendedprice::DOUBLE, 0.5)", 4)} AS p50,
  {round_sql("quantile_cont(l_extendedprice::DOUBLE, 0.75)", 4)} AS p75, max(l_extendedprice)::DOUBLE AS max FROM lineitem""",
    "coerce_numeric_text": """SELECT l_orderkey, l_linenumber, TRY_CAST(trim(l_quantity::DOUBLE::VARCHAR || CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN 'd'
  WHEN 2 THEN 'e2' WHEN 3 THEN '  ' ELSE ' items' END) AS DOUBLE) AS quantity FROM lineitem""",
    "lexicon_sentiment_large": f"WITH {LARGE_LEXICON}",
    "classifier_checks": CLASSIFIER_CHECKS,
    "clean_text": f"SELECT doc_id, {clean_sql('text')} AS cleaned_text FROM documents",
    "strip_urls": f"SELECT page_id, regexp_replace(html, {q(T.URL_RE)}, '', 'g') AS html_no_urls FROM pages",
    "terms_found": f"SELECT doc_id, {_family_cols('t', PROFILE_V2, 'found')} FROM {CLEANED_DOCS}",
    "terms_found_demo": f"SELECT doc_id, {_family_cols('t', DEMO_PROFILE, 'found')} FROM {CLEANED_DOCS}",
    "term_counts": f"SELECT doc_id, {_family_cols('t', PROFILE_V2, 'count')} FROM {CLEANED_DOCS}",
    "relevance_score": f"SELECT doc_id, {score_sql('t', PROFILE_V2)} AS relevance_score FROM {CLEANED_DOCS}",
    "dedupe_raw": DEDUPED_DOCS,
    "clean_dataset": clean_dataset_sql(V2_AT_025),
    "relevant_posts_demo": clean_dataset_sql(DEMO_PROFILE),
    "stage_counts": f"""WITH g AS (SELECT text, count(*) AS copies FROM documents GROUP BY text),
s AS (SELECT copies, {score_sql('t', DEMO_PROFILE)} AS sc FROM (SELECT copies, {clean_sql('text')} AS t FROM g))
SELECT sum(copies)::BIGINT AS raw_rows, count(*) AS deduped_rows, count_if(sc >= {DEMO_PROFILE.threshold}::DOUBLE)::BIGINT AS kept_rows FROM s""",
    "score_describe": f"""WITH s AS (SELECT {score_sql('t', DEMO_PROFILE)} AS relevance_score
  FROM (SELECT {clean_sql('text')} AS t FROM ({DEDUPED_DOCS})))
SELECT count(relevance_score) AS count, {round_sql("avg(relevance_score)", 6)} AS mean,
  {round_sql("stddev_samp(relevance_score)", 6)} AS std, {round_sql("min(relevance_score)", 6)} AS min,
  {round_sql("quantile_cont(relevance_score, 0.25)", 6)} AS p25, {round_sql("quantile_cont(relevance_score, 0.5)", 6)} AS p50,
  {round_sql("quantile_cont(relevance_score, 0.75)", 6)} AS p75, {round_sql("max(relevance_score)", 6)} AS max FROM s""",
    "term_count_means": f"WITH {_cleaned_flow(DEMO_PROFILE)}\nSELECT "
    + ", ".join(f"{round_sql(f'avg({f}_term_count)', 6)} AS avg_{f}_terms" for f in DEMO_PROFILE.families)
    + " FROM kept",
    "preview_posts": f"WITH {_cleaned_flow(DEMO_PROFILE)}\nSELECT doc_id, substring(text, 1, 100) || '...' AS original_preview, "
    "substring(cleaned_text, 1, 100) || '...' AS cleaned_preview, printf('%.2f', relevance_score) AS score_text, "
    + ", ".join(f"{f}_terms_found" for f in DEMO_PROFILE.families)
    + " FROM kept ORDER BY doc_id LIMIT 3",
    "na_tokens": f"""SELECT count(*) AS words, count_if(word IN ({NA_LIST}))::BIGINT AS missing
FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)""",
    "drop_null_label": f"SELECT doc_id, label FROM {DOCS_WITH_LABEL} WHERE label IS NOT NULL",
    "drop_stats": f"SELECT count(*) AS initial_rows, count_if(label IS NULL)::BIGINT AS dropped_rows, count(label) AS kept_rows FROM {DOCS_WITH_LABEL}",
    "label_distribution": f"SELECT label, count(*) AS n FROM {DOCS_WITH_LABEL} WHERE label IS NOT NULL GROUP BY label ORDER BY label",
    "polarity_counts": f"SELECT count_if(label = 1)::BIGINT AS positive, count_if(label = 0)::BIGINT AS negative FROM {DOCS_WITH_LABEL}",
    "label_map": "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0 WHEN c_nationkey = 4 THEN 1 END AS sentiment FROM customer",
    "coerce_numeric": """WITH v AS (SELECT event_id, TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS a,
  TRY_CAST(trim(props) AS DOUBLE) AS b FROM events)
SELECT event_id, CASE WHEN isnan(a) THEN NULL ELSE a END AS k_value, CASE WHEN isnan(b) THEN NULL ELSE b END AS props_value FROM v""",
    "parse_post_time": """SELECT event_id,
  (try_strptime(strftime(ts, '%a %b %d %H:%M:%S +0000 %Y'), '%a %b %d %H:%M:%S %z %Y') AT TIME ZONE 'UTC') AS parsed,
  (try_strptime(props, '%a %b %d %H:%M:%S %z %Y') AT TIME ZONE 'UTC') AS parsed_junk
FROM events""",
    "sentinel_replace": "SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type FROM events",
    "tokenize_words": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token",
    "topic_share": topic_share_sql(TOPIC_KEYWORDS, TOPIC_LABELS),
    "topic_share_demo": topic_share_sql(DEMO_TOPICS, DEMO_TOPIC_LABELS),
    "topic_keyword_counts": keyword_counts_sql(DEMO_TOPICS),
    "union_platforms": """SELECT *, 'documents' AS platform, 0 AS source_rank FROM documents
UNION ALL BY NAME SELECT *, 'conversations' AS platform, 1 AS source_rank FROM conversations
UNION ALL BY NAME SELECT *, 'benchmark' AS platform, 2 AS source_rank FROM benchmark""",
    "min_length_filter": f"SELECT doc_id, t AS cleaned_text FROM {CLEANED_DOCS} WHERE length(t) > 10",
    "prepare_corpus": f"""WITH p AS (
  SELECT 'documents' AS platform, 0 AS source_rank, doc_id AS k1, 0::BIGINT AS k2, {clean_sql('text')} AS cleaned_text FROM documents
  UNION ALL SELECT 'conversations', 1, conv_id, turn, {clean_sql('text')} FROM conversations
  UNION ALL SELECT 'benchmark', 2, item_id, 0::BIGINT, {clean_sql('text')} FROM benchmark)
SELECT platform, source_rank, k1, k2, cleaned_text FROM p WHERE length(cleaned_text) > 10
QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY source_rank, k1, k2) = 1""",
    "dedupe_clean_cross_source": f"""WITH u AS (
  SELECT 'documents' AS platform, 0 AS source_rank, doc_id, {clean_sql('text')} AS cleaned_text FROM documents
  UNION ALL SELECT 'emphasised', 1, doc_id, {clean_sql("text || ' !!'")} FROM documents)
SELECT platform, doc_id, cleaned_text FROM u
QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY source_rank, doc_id) = 1""",
    "lexicon_sentiment": f"WITH {LABELLED}\nSELECT doc_id, polarity, subjectivity, lexicon_hits FROM labelled",
    "weak_sentiment_label": f"WITH {LABELLED}\nSELECT doc_id, sentiment FROM labelled",
    "class_histogram": f"WITH {LABELLED}\nSELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment",
    "balance_target": f"""WITH {LABELLED},
cnt AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment)
SELECT greatest(floor(median(n)), 10)::BIGINT AS target FROM cnt""",
    "balance_classes": f"WITH {BALANCED}\nSELECT doc_id, replica, sentiment FROM balanced",
    "seeded_sample": f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('{RANDOM_SEED}:' || doc_id::VARCHAR), doc_id) <= 100",
    "stratified_split": f"WITH {SPLIT}\nSELECT row_key, sentiment, fold FROM split",
    "vocabulary_index": f"WITH {VOCAB}\nSELECT word, count, id FROM vocab",
    "token_sequences": f"WITH {SEQUENCES}\nSELECT doc_id, coalesce(array_to_string(idl, ' '), '') AS seq FROM seqs",
    "padded_sequences": f"WITH {SEQUENCES}\nSELECT doc_id, array_to_string(list_resize(coalesce(idl, []::INTEGER[]), {MAX_LEN}, 0), ' ') AS padded FROM seqs",
    "label_index_nullable": f"SELECT doc_id, label, (dense_rank() OVER (ORDER BY label NULLS LAST) - 1)::INTEGER AS label_idx FROM {DOCS_WITH_LABEL}",
    "split_nullable": f"WITH dl AS {DOCS_WITH_LABEL},\n{split_ctes('dl', 'label', 'doc_id')}\nSELECT doc_id, label, fold FROM split",
    "vocabulary_capped": f"WITH {vocab_ctes(1000)}\nSELECT word, count, id FROM vocab",
    "label_index": "SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS label_idx FROM documents",
    "one_hot_label": """WITH l AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS i FROM documents)
SELECT doc_id, array_to_string([(i = 0)::INTEGER::DOUBLE, (i = 1)::INTEGER::DOUBLE, (i = 2)::INTEGER::DOUBLE, (i = 3)::INTEGER::DOUBLE], ',') AS one_hot FROM l""",
    "prediction_record": f"WITH {PREDICTED}\nSELECT cleaned_text AS \"Text\", {PRED_COLS} FROM predictions",
    "negative_predictions": f"WITH {PREDICTED}\nSELECT * FROM (SELECT cleaned_text AS \"Text\", {PRED_COLS} FROM predictions) WHERE \"Predicted_Sentiment\" = 2",
    "topic_report_negative": topic_share_sql(
        DEMO_TOPICS,
        DEMO_TOPIC_LABELS,
        source="neg",
        prefix=f"{PREDICTED},\nneg AS (SELECT cleaned_text AS text FROM predictions WHERE predicted = 2),\n",
    ),
    "confusion_matrix": f"""WITH {PREDICTED},
grid AS (SELECT a.t::INTEGER AS y_true, b.p::INTEGER AS y_pred FROM range(3) a(t), range(3) b(p)),
cm AS (SELECT sentiment AS y_true, predicted AS y_pred, count(*) AS n FROM predictions GROUP BY 1, 2)
SELECT g.y_true, g.y_pred, coalesce(cm.n, 0)::BIGINT AS n FROM grid g LEFT JOIN cm USING (y_true, y_pred)""",
    "classification_report": _report_sql(),
    "platform_sentiment_summary": f"""WITH {PLATFORM_RECORDS}
SELECT "Platform", "Predicted_Sentiment", count(*) AS n, {round_sql('avg("Confidence_Score")', 6)} AS avg_confidence
FROM recs GROUP BY 1, 2""",
    "combined_negative": f"WITH {PLATFORM_RECORDS}\nSELECT * FROM recs WHERE \"Predicted_Sentiment\" = 2",
}
