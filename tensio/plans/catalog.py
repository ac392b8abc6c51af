"""Every operator as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Column names equal those of the SQL in ``tensio.plans.oracle``; arrays are rendered as
space-separated strings so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.functions import text as T
from tensio.functions.lexicons import MAX_LEN, PROFILE_V2
from tensio.functions.numeric import round_places
from tensio.operators import cleaning, corpus, encode, evaluate, quantiles, sampling, sentiment, topics
from tensio.operators.cleaning import CLEAN, SCORE
from tensio.operators.partitioning import materialize
from tensio.plans import flows
from tensio.plans.demo import DEMO_PROFILE, DEMO_TOPIC_LABELS, DEMO_TOPICS, V2_AT_025
from tensio.sources.adapters import label_distribution as _label_distribution
from tensio.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _ints_to_text(col) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


# ---- cleaning and scoring (O23, O24, O30-O32, O18, O39, O41, O42b, O22) ----------------
# Flows that dedupe first read the table as is: the dedupe exchange already spreads the
# regex work over the shuffle partitions.  Flows that clean right after the scan use
# ``flows.texts``, which spreads a scan that has fewer splits than cores.


def q_clean_text(spark, sf):
    docs = flows.texts(spark, sf, "documents")
    return docs.select("doc_id", T.clean_text("text").alias(CLEAN))


def q_strip_urls(spark, sf):
    pages = flows.texts(spark, sf, "pages")
    return pages.select("page_id", T.strip_urls("html").alias("html_no_urls"))


def q_terms_found(spark, sf):
    docs = cleaning.with_clean_text(flows.texts(spark, sf, "documents").select("doc_id", "text"), "text")
    return cleaning.with_found_terms(docs, PROFILE_V2).drop("text", CLEAN)


def q_terms_found_demo(spark, sf):
    docs = cleaning.with_clean_text(flows.texts(spark, sf, "documents").select("doc_id", "text"), "text")
    return cleaning.with_found_terms(docs, DEMO_PROFILE).drop("text", CLEAN)


def q_term_counts(spark, sf):
    docs = cleaning.with_clean_text(flows.texts(spark, sf, "documents").select("doc_id", "text"), "text")
    return cleaning.with_term_counts(docs, PROFILE_V2).drop("text", CLEAN)


def q_relevance_score(spark, sf):
    docs = flows.texts(spark, sf, "documents").select("doc_id", "text")
    return cleaning.score_posts(docs, "text", PROFILE_V2).select("doc_id", SCORE)


def q_dedupe_raw(spark, sf):
    return cleaning.dedupe_first(read_table(spark, sf, "documents"), ["text"], ["doc_id"])


def q_clean_dataset(spark, sf):
    """Reference dictionaries and effective weights, cut at 0.25."""
    return cleaning.clean_dataset(flows.texts(spark, sf, "documents"), "text", ["doc_id"], V2_AT_025)


def q_relevant_posts_demo(spark, sf):
    """The same flow with the demo families at the reference's 0.5 threshold."""
    return cleaning.clean_dataset(flows.texts(spark, sf, "documents"), "text", ["doc_id"], DEMO_PROFILE)


def q_stage_counts(spark, sf):
    return cleaning.stage_counts(flows.texts(spark, sf, "documents"), "text", DEMO_PROFILE)


def q_score_describe(spark, sf):
    docs = cleaning.dedupe_first(read_table(spark, sf, "documents"), ["text"], ["doc_id"])
    scored = cleaning.score_posts(docs, "text", DEMO_PROFILE)
    d = cleaning.score_describe(scored)
    return d.select("count", *[round_places(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_term_count_means(spark, sf):
    kept = cleaning.clean_dataset(flows.texts(spark, sf, "documents"), "text", ["doc_id"], DEMO_PROFILE)
    m = cleaning.term_count_means(kept, DEMO_PROFILE)
    return m.select(*[round_places(c, 6).alias(c) for c in m.columns])


def q_preview_posts(spark, sf):
    kept = cleaning.clean_dataset(flows.texts(spark, sf, "documents"), "text", ["doc_id"], DEMO_PROFILE)
    return cleaning.preview(kept, "text", ["doc_id"])


# ---- missing values, drops, value maps, parsing (O07, O15, O16, O26-O29, O40, O42) -----


def _docs_with_label(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id", "left")


def q_na_tokens(spark, sf):
    """Missing-token normalisation on every word of the documents (split on spaces)."""
    words = flows.texts(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    norm = words.select(T.na_to_null("word").alias("word"))
    return norm.agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("word").isNull()).alias("missing"))


def q_drop_null_label(spark, sf):
    return cleaning.drop_null(_docs_with_label(spark, sf), ["label"])


def q_drop_stats(spark, sf):
    return cleaning.drop_stats(_docs_with_label(spark, sf), "label")


def q_label_distribution(spark, sf):
    return _label_distribution(_docs_with_label(spark, sf), "label")


def q_polarity_counts(spark, sf):
    lab = _docs_with_label(spark, sf)
    return lab.agg(
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
    )


def q_label_map(spark, sf):
    cust = read_table(spark, sf, "customer")
    return cust.select("c_custkey", T.value_map("c_nationkey", {0: 0, 4: 1}).alias("sentiment"))


def q_coerce_numeric(spark, sf):
    ev = read_table(spark, sf, "events")
    # the JSON value text of each event, and the raw props text, both coerced
    return ev.select(
        "event_id",
        T.coerce_numeric(F.get_json_object("props", "$.k")).alias("k_value"),
        T.coerce_numeric("props").alias("props_value"),
    )


def q_coerce_numeric_text(spark, sf):
    """Order quantities as text, some with a type letter, an exponent, blanks or a word behind."""
    kind = F.col("l_linenumber") % 5
    tail = F.when(kind == 0, "").when(kind == 1, "d").when(kind == 2, "e2").when(kind == 3, "  ").otherwise(" items")
    text = F.concat(F.col("l_quantity").cast("double").cast("string"), tail)
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.coerce_numeric(text).alias("quantity"))


def q_parse_post_time(spark, sf):
    ev = read_table(spark, sf, "events")
    made = ev.select(
        "event_id",
        F.date_format("ts", "EEE MMM dd HH:mm:ss xx yyyy").alias("post_created"),
        F.col("props").alias("junk"),
    )
    return made.select(
        "event_id",
        T.parse_post_time("post_created").alias("parsed"),
        T.parse_post_time("junk").alias("parsed_junk"),
    )


def q_sentinel_replace(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", T.sentinel_replace("event_type", "view", "").alias("event_type"))


# ---- tokens and topics (O33, O43, O43b, O37) -------------------------------------------


def q_tokenize_words(spark, sf):
    docs = flows.texts(spark, sf, "documents")
    return docs.select(F.explode(T.tokenize_words("text")).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


def q_topic_share(spark, sf):
    return topics.topic_share(flows.texts(spark, sf, "documents"), "text")


def q_topic_share_demo(spark, sf):
    return topics.topic_share(flows.texts(spark, sf, "documents"), "text", DEMO_TOPICS, DEMO_TOPIC_LABELS)


def q_topic_keyword_counts(spark, sf):
    return topics.topic_keyword_counts(flows.texts(spark, sf, "documents"), "text", DEMO_TOPICS)


# ---- corpus preparation (O17, O34, O35, O08) ------------------------------------------


def q_union_platforms(spark, sf):
    # a plain union does no per-row work, so the scans are not spread
    frames = [
        ("documents", read_table(spark, sf, "documents")),
        ("conversations", read_table(spark, sf, "conversations")),
        ("benchmark", read_table(spark, sf, "benchmark")),
    ]
    return corpus.union_sources(frames)


def q_min_length_filter(spark, sf):
    docs = cleaning.with_clean_text(flows.texts(spark, sf, "documents").select("doc_id", "text"), "text")
    return corpus.min_length(docs).select("doc_id", CLEAN)


def q_prepare_corpus(spark, sf):
    prepared = corpus.prepare_corpus(flows.platform_posts(spark, sf), "text", ["k1", "k2"])
    return prepared.select("platform", "source_rank", "k1", "k2", CLEAN)


def q_dedupe_clean_cross_source(spark, sf):
    """Documents, and the same documents re-posted with emphasis (`` !!``) as a second source."""
    docs = flows.texts(spark, sf, "documents").select("doc_id", "text")
    emphasised = docs.select("doc_id", F.concat("text", F.lit(" !!")).alias("text"))
    cleaned = [(n, cleaning.with_clean_text(d, "text")) for n, d in (("documents", docs), ("emphasised", emphasised))]
    out = corpus.dedupe_cross_source(corpus.union_sources(cleaned), ["doc_id"])
    return out.select("platform", "doc_id", CLEAN)


# ---- sentiment labels and sampling (O56, O57, O45, O46, O44, O44a, O51) ----------------


def q_lexicon_sentiment(spark, sf):
    return flows.labelled_documents(spark, sf).select("doc_id", "polarity", "subjectivity", "lexicon_hits")


def q_lexicon_sentiment_large(spark, sf):
    """A lexicon of all words of the corpus, with repeated words and NULL values, joined to the tokens."""
    corp = materialize(flows.document_corpus(spark, sf))  # the lexicon's words and the scores both read it
    words = materialize(corp.select(F.explode(T.space_tokens(CLEAN)).alias("word")).distinct())
    size = F.length("word")
    first = words.select("word", ((size * 7 % 21 - 10) / 10).alias("polarity"), (size % 11 / 10).alias("subjectivity"))
    again = first.where(size % 3 == 0).select("word", (F.col("polarity") + 0.5).alias("polarity"), F.lit(0.0).alias("subjectivity"))
    unknown = first.where(size % 4 == 0).select("word", F.lit(None).cast("double").alias("polarity"), "subjectivity")
    lexicon = first.unionByName(again).unionByName(unknown)
    scored = sentiment.lexicon_scores(corp, T.space_tokens(CLEAN), lexicon, "doc_id", broadcast_limit=1000)
    return scored.select("doc_id", "polarity", "subjectivity", "lexicon_hits")


def q_weak_sentiment_label(spark, sf):
    return flows.labelled_documents(spark, sf).select("doc_id", "sentiment")


def q_class_histogram(spark, sf):
    return sentiment.class_histogram(flows.labelled_documents(spark, sf))


def q_balance_target(spark, sf):
    return sampling.balance_target(sampling.class_counts(flows.labelled_documents(spark, sf), "sentiment"))


def q_balance_classes(spark, sf):
    return flows.balanced_documents(spark, sf).select("doc_id", "replica", "sentiment")


def q_seeded_sample(spark, sf):
    return sampling.seeded_sample(read_table(spark, sf, "documents").select("doc_id"), 100, "doc_id")


def q_stratified_split(spark, sf):
    bal = materialize(flows.balanced_documents(spark, sf).select("row_key", "sentiment"))
    return sampling.stratified_split(bal, "sentiment", "row_key")


def q_split_nullable(spark, sf):
    """A split whose strata include documents without a label."""
    return sampling.stratified_split(_docs_with_label(spark, sf), "label", "doc_id")


def q_vocabulary_capped(spark, sf):
    """The vocabulary with a cap that binds."""
    return encode.vocabulary(flows.document_corpus(spark, sf), CLEAN, max_words=1000)


# ---- encoding (O49, O52-O55) ------------------------------------------------------------


def q_vocabulary_index(spark, sf):
    return encode.vocabulary(flows.document_corpus(spark, sf), CLEAN)


def q_token_sequences(spark, sf):
    enc = flows.encoded_documents(spark, sf)
    return enc.select("doc_id", _ints_to_text(F.col("seq")).alias("seq"))


def q_padded_sequences(spark, sf):
    enc = flows.encoded_documents(spark, sf, limit=MAX_LEN)
    return enc.select("doc_id", _ints_to_text(encode.pad("seq")).alias("padded"))


def q_label_index(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return encode.label_index(docs, "lang")


def q_label_index_nullable(spark, sf):
    """Labels with NULLs: documents without a label share the last index."""
    return encode.label_index(_docs_with_label(spark, sf), "label")


def q_one_hot_label(spark, sf):
    docs = encode.label_index(read_table(spark, sf, "documents").select("doc_id", "lang"), "lang")
    hot = encode.one_hot("label_idx", 4)
    return docs.select("doc_id", F.array_join(F.transform(hot, lambda x: x.cast("string")), ",").alias("one_hot"))


# ---- prediction records and evaluation (O50, O19, O47, O48, O60, O61) ------------------


def q_prediction_record(spark, sf):
    bal = flows.standin_probabilities(flows.balanced_documents(spark, sf), "doc_id")
    return evaluate.prediction_record(bal, CLEAN, ["p0", "p1", "p2"])


def q_negative_predictions(spark, sf):
    rec = q_prediction_record(spark, sf)
    return rec.filter(F.col("Predicted_Sentiment") == 2)


def q_topic_report_negative(spark, sf):
    """Topic share over the texts of the negative prediction records (the topic step of the study)."""
    negative = q_negative_predictions(spark, sf)
    return topics.topic_share(negative, "Text", DEMO_TOPICS, DEMO_TOPIC_LABELS)


def q_confusion_matrix(spark, sf):
    pred = flows.balanced_predictions(spark, sf)
    return evaluate.confusion_matrix(pred, "sentiment", "predicted")


def q_classification_report(spark, sf):
    pred = flows.balanced_predictions(spark, sf)
    return evaluate.classification_report(pred, "sentiment", "predicted")


def q_platform_sentiment_summary(spark, sf):
    rec = flows.platform_predictions(spark, sf)
    return rec.groupBy("Platform", "Predicted_Sentiment").agg(
        F.count(F.lit(1)).alias("n"), round_places(F.avg("Confidence_Score"), 6).alias("avg_confidence")
    )


def q_combined_negative(spark, sf):
    rec = flows.platform_predictions(spark, sf)
    return rec.filter(F.col("Predicted_Sentiment") == 2)


# ---- classifier (O58, O59): no SQL equivalent -------------------------------------------


def q_classify_posts(spark, sf):
    """Train on the balanced training fold; prediction records for the balanced training
    rows and the held-out fold."""
    from tensio.plans.sentiment_flow import run_sentiment

    return run_sentiment(flows.labelled_corpus_stage(spark, sf), "doc_id").predictions


def q_classifier_report(spark, sf):
    """Classification report of the trained classifier on the held-out fold."""
    from tensio.plans.sentiment_flow import run_sentiment

    return run_sentiment(flows.labelled_corpus_stage(spark, sf), "doc_id").report


def q_classifier_checks(spark, sf):
    """What must hold of the trained classifier: rows per fold, probabilities that sum to 1, the
    predicted class being the first largest, and an accuracy above the majority class's."""
    from tensio.plans.sentiment_flow import run_sentiment

    run = run_sentiment(flows.labelled_corpus_stage(spark, sf), "doc_id")
    test = materialize(run.test)
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    largest = F.greatest(*p)
    first = F.when(p[0] == largest, 0).when(p[1] == largest, 1).otherwise(2)
    found = test.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.abs(p[0] + p[1] + p[2] - 1) > 1e-6).alias("wrong_sums"),
        F.count_if((F.col("predicted") != first) | (F.col("confidence") != largest)).alias("wrong_argmax"),
        F.count_if(F.col("predicted") == F.col("sentiment")).alias("right"),
    )
    majority = sentiment.class_histogram(test).agg(F.max("n").alias("majority"))
    rows = run.predictions.agg(F.count(F.lit(1)).alias("scored_rows"))
    parts = found.unionByName(majority, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    total = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    return total.select("scored_rows", "test_rows", "wrong_sums", "wrong_argmax", (F.col("right") > F.col("majority")).alias("beats_majority"))


def q_platform_models(spark, sf):
    """One model per platform, trained together: what must hold of each (rows, probabilities, the
    first largest wins, the pass budget, and that the weights of the least validation loss stayed)."""
    from tensio.operators.grouped_classifier import MAX_PASSES
    from tensio.plans.sentiment_flow import run_platforms

    run = run_platforms(flows.labelled_platforms(spark, sf), "key")
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    largest = F.greatest(*p)
    first = F.when(p[0] == largest, 0).when(p[1] == largest, 1).otherwise(2)
    tested = run.test.groupBy("platform").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.abs(p[0] + p[1] + p[2] - 1) > 1e-6).alias("wrong_sums"),
        F.count_if((F.col("predicted") != first) | (F.col("confidence") != largest)).alias("wrong_argmax"),
        F.sum(-F.log(F.element_at(F.array(*p), F.col("sentiment") + 1)) * F.when(F.col("sentiment") == 2, 1.2).otherwise(1.0)).alias("loss"),
        F.sum(F.when(F.col("sentiment") == 2, 1.2).otherwise(1.0)).alias("weight"),
    )
    trained = run.train.groupBy("platform").agg(F.count(F.lit(1)).alias("trained_rows"))
    history = flows.training_history(spark, run.model).groupBy("platform").agg(F.min("validation_loss").alias("least"), F.max("pass").alias("passes"))
    out = tested.join(trained, "platform").join(history, "platform")
    kept = F.abs(F.col("loss") / F.col("weight") - F.col("least")) < 1e-9
    return out.select("platform", "trained_rows", "test_rows", "wrong_sums", "wrong_argmax", (F.col("passes") <= MAX_PASSES).alias("within_budget"), kept.alias("best_kept"))


def q_platform_accuracy(spark, sf):
    """Accuracy of each platform's own model on its test fold."""
    from tensio.plans.sentiment_flow import run_platforms

    return run_platforms(flows.labelled_platforms(spark, sf), "key").accuracy


def q_training_history(spark, sf):
    """Training and validation loss of each platform's model, pass by pass."""
    from tensio.plans.sentiment_flow import run_platforms

    return flows.training_history(spark, run_platforms(flows.labelled_platforms(spark, sf), "key").model)


def q_keyword_bag(spark, sf):
    return topics.keyword_bag(flows.texts(spark, sf, "documents"), "text", ["doc_id"], DEMO_TOPICS)


def q_describe_prices(spark, sf):
    """A column whose values nearly all differ."""
    d = quantiles.describe_column(read_table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice")
    return d.select("count", *[round_places(c, 4).alias(c) for c in ("mean", "std")], "min", *[round_places(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


QUERIES: dict[str, Query] = {
    "platform_models": q_platform_models,
    "platform_accuracy": q_platform_accuracy,
    "training_history": q_training_history,
    "keyword_bag": q_keyword_bag,
    "describe_prices": q_describe_prices,
    "clean_text": q_clean_text,
    "strip_urls": q_strip_urls,
    "terms_found": q_terms_found,
    "terms_found_demo": q_terms_found_demo,
    "term_counts": q_term_counts,
    "relevance_score": q_relevance_score,
    "dedupe_raw": q_dedupe_raw,
    "clean_dataset": q_clean_dataset,
    "relevant_posts_demo": q_relevant_posts_demo,
    "stage_counts": q_stage_counts,
    "score_describe": q_score_describe,
    "term_count_means": q_term_count_means,
    "preview_posts": q_preview_posts,
    "na_tokens": q_na_tokens,
    "drop_null_label": q_drop_null_label,
    "drop_stats": q_drop_stats,
    "label_distribution": q_label_distribution,
    "polarity_counts": q_polarity_counts,
    "label_map": q_label_map,
    "coerce_numeric": q_coerce_numeric,
    "coerce_numeric_text": q_coerce_numeric_text,
    "parse_post_time": q_parse_post_time,
    "sentinel_replace": q_sentinel_replace,
    "tokenize_words": q_tokenize_words,
    "topic_share": q_topic_share,
    "topic_share_demo": q_topic_share_demo,
    "topic_keyword_counts": q_topic_keyword_counts,
    "union_platforms": q_union_platforms,
    "min_length_filter": q_min_length_filter,
    "prepare_corpus": q_prepare_corpus,
    "dedupe_clean_cross_source": q_dedupe_clean_cross_source,
    "lexicon_sentiment": q_lexicon_sentiment,
    "lexicon_sentiment_large": q_lexicon_sentiment_large,
    "weak_sentiment_label": q_weak_sentiment_label,
    "class_histogram": q_class_histogram,
    "balance_target": q_balance_target,
    "balance_classes": q_balance_classes,
    "seeded_sample": q_seeded_sample,
    "stratified_split": q_stratified_split,
    "vocabulary_index": q_vocabulary_index,
    "token_sequences": q_token_sequences,
    "padded_sequences": q_padded_sequences,
    "label_index": q_label_index,
    "label_index_nullable": q_label_index_nullable,
    "split_nullable": q_split_nullable,
    "vocabulary_capped": q_vocabulary_capped,
    "one_hot_label": q_one_hot_label,
    "prediction_record": q_prediction_record,
    "negative_predictions": q_negative_predictions,
    "topic_report_negative": q_topic_report_negative,
    "confusion_matrix": q_confusion_matrix,
    "classification_report": q_classification_report,
    "platform_sentiment_summary": q_platform_sentiment_summary,
    "combined_negative": q_combined_negative,
    "classify_posts": q_classify_posts,
    "classifier_report": q_classifier_report,
    "classifier_checks": q_classifier_checks,
}
