"""Command line for the study flow: ``python -m tensio {clean,sentiment,topics} ...``.

    python -m tensio clean --out OUT mental_health_twitter=Mental-Health-Twitter.csv twitter_data_2=twitter_data_2.csv
    python -m tensio sentiment --out OUT --platform Twitter --lexicon lexicon.parquet OUT/cleaned_mental_health_twitter ...
    python -m tensio combine --out OUT Twitter Reddit
    python -m tensio topics OUT/negative_sentiment_predictions_twitter

The session is taken from the environment (``spark-submit``) or created locally.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tensio.plans import study
from tensio.session import ensure_checkpoint_dir, stage_scope


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("tensio").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m tensio")
    sub = parser.add_subparsers(dest="cmd", required=True)

    c = sub.add_parser("clean", help="clean raw source files (layout=path ...)")
    c.add_argument("--out", required=True)
    c.add_argument("--report", action="store_true", help="show stage counts, score distribution, previews, means and reader notes")
    c.add_argument("sources", nargs="+", help=f"layout=path; layouts: {', '.join(study.LOADERS)}")

    s = sub.add_parser("sentiment", help="labels, classifier and prediction exports for one platform")
    s.add_argument("--out", required=True)
    s.add_argument("--platform", required=True)
    s.add_argument("--lexicon", required=True, help="Parquet or CSV with word, polarity, subjectivity")
    s.add_argument("--original-order", action="store_true", help="balance before splitting (as the original)")
    s.add_argument("cleaned", nargs="+")

    m = sub.add_parser("combine", help="combine the per-platform negative exports")
    m.add_argument("--out", required=True)
    m.add_argument("--label", default="negative")
    m.add_argument("platforms", nargs="+")

    t = sub.add_parser("topics", help="topic share of a predictions export")
    t.add_argument("path")
    t.add_argument("--text-col", default="Text")

    args = parser.parse_args(argv)
    spark = _session()
    with stage_scope(spark):  # everything is shown or written to its own place inside
        _run(spark, args)
    return 0


def _run(spark, args) -> None:
    if args.cmd == "clean":
        inputs = dict(item.split("=", 1) for item in args.sources)
        for layout, result in study.clean_sources(spark, inputs, args.out).items():
            status = f"{result.count()} posts kept" if not isinstance(result, Exception) else f"skipped: {result}"
            print(f"{layout}: {status}")
            if args.report and not isinstance(result, Exception):
                report = study.source_report(spark, layout, inputs[layout])
                for part in (report.counts, report.scores, report.preview, report.means, *report.notes.values()):
                    part.show(truncate=False)
    elif args.cmd == "sentiment":
        reader = spark.read.parquet if not args.lexicon.endswith(".csv") else spark.read.option("header", True).csv
        lexicon = reader(args.lexicon)
        run = study.analyze_platform(
            spark, args.cleaned, args.platform, args.out, lexicon, split_before_balance=not args.original_order
        )
        for part in (run.classes, run.accuracy, run.report):
            part.show(truncate=False)
    elif args.cmd == "combine":
        print(f"{study.combine_class_exports(spark, args.out, args.platforms, args.label).count()} rows combined")
    elif args.cmd == "topics":
        study.topic_report(spark, args.path, args.text_col).show(truncate=False)


if __name__ == "__main__":
    sys.exit(main())
