"""Command line: ``python -m reqloom.cli <command> ...``.

Commands on tables read and write Parquet; those from ``topics`` on begin stamped
runs, local or in a store, and take ``latest`` for the newest one. ``--settings``
(before the command) names a YAML file whose section of the command's name gives its arguments'
defaults; what is written on the command line comes first.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reqloom.operators import ingest, preprocess, sentences, sentiment
from reqloom.plans import registry, stages
from reqloom.sources import files
from reqloom.sources.runs import Run, latest


def _session() -> SparkSession:
    return SparkSession.builder.appName("reqloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    records = files.read_json_array(spark, args.input)
    overrides = files.read_overrides(spark, args.overrides) if args.overrides else None
    ingest.build_documents(records, overrides).write.parquet(args.output)


def _preprocess(spark: SparkSession, args: argparse.Namespace) -> None:
    preprocess.preprocess(spark.read.parquet(args.input), "post_id", chars=args.chars, words=args.words).write.parquet(args.output)


def _sentences(spark: SparkSession, args: argparse.Namespace) -> None:
    sentences.build_sentences(spark.read.parquet(args.input), window=args.window).write.parquet(args.output)


def _sentiment(spark: SparkSession, args: argparse.Namespace) -> None:
    sentiment.classify(spark.read.parquet(args.input)).write.parquet(args.output)


def _run(args: argparse.Namespace, prefix: str) -> Run:
    return Run(latest(args.runs, prefix) if args.run_path == "latest" else args.run_path)


def _topics(spark: SparkSession, args: argparse.Namespace) -> None:
    for run in stages.run_global_topics(spark, spark.read.parquet(args.input), args.runs, args.k, args.seed, args.text, args.min_df, args.max_df, args.max_features, args.rounds):
        print(run.path)


def _local_topics(spark: SparkSession, args: argparse.Namespace) -> None:
    stages.run_local_topics(spark, _run(args, f"nmf_global_k{args.k:02d}"), args.topics, args.expected, args.local_k, args.seed, args.rounds, args.no_below, args.no_above)


def _review(spark: SparkSession, args: argparse.Namespace) -> None:
    print(stages.run_review(spark, _run(args, f"nmf_global_k{args.k:02d}"), args.topics, args.runs, args.expected, args.top_k, args.n_random, args.seed).path)


def _score(spark: SparkSession, args: argparse.Namespace) -> None:
    annotations = files.read_csv_folder(spark, args.input, columns=["review_id", "requirement_candidate"]).select(F.col("review_id").cast("int"), "requirement_candidate")
    run = _run(args, "review")
    precision, confirmed = stages.score_review(spark, run, annotations)
    run.write("precision", precision)
    run.write("confirmed_by_topic", confirmed)


def _summaries(spark: SparkSession, args: argparse.Namespace) -> None:
    print(stages.run_sentiment(spark, spark.read.parquet(args.input), _run(args, "review"), args.runs).path)


def _export(spark: SparkSession, args: argparse.Namespace) -> None:
    stages.run_export(spark, spark.read.parquet(args.input), _run(args, "sentiment")).write.parquet(args.output)


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    registry.QUERIES[args.name](spark, args.tables).write.parquet(args.output)


def _parser() -> tuple[argparse.ArgumentParser, dict[str, argparse.ArgumentParser]]:
    parser = argparse.ArgumentParser(prog="reqloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--settings")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *needed: str, **defaults) -> argparse.ArgumentParser:
        added = commands.add_parser(name)
        for option in needed:
            added.add_argument(f"--{option}", required=True)
        for option, value in defaults.items():
            several = isinstance(value, tuple)
            kind = type(value[0]) if several else int if value is None else type(value)
            added.add_argument(f"--{option.replace('_', '-')}", type=kind, default=value, nargs="+" if several else None)
        added.set_defaults(run=run)
        return added

    command("build", _build, "input", "output").add_argument("--overrides")
    command("preprocess", _preprocess, "input", "output", chars=500, words=100)
    command("sentences", _sentences, "input", "output", window=1)
    command("sentiment", _sentiment, "input", "output")
    command("topics", _topics, "input", "runs", k=(20,), seed=42, text="sentence", min_df=20, max_df=0.5, max_features=12_000, rounds=300)
    chosen = {"run_path": "latest", "k": 20, "expected": None, "seed": 42}
    command("local-topics", _local_topics, "runs", local_k=(2, 3, 4, 5, 6), rounds=60, no_below=5, no_above=0.5, **chosen)
    command("review", _review, "runs", top_k=50, n_random=100, **chosen)
    for name in ("local-topics", "review"):
        commands.choices[name].add_argument("--topics", type=int, nargs="+", required=True)
    command("score", _score, "input", "runs", run_path="latest")
    command("summaries", _summaries, "input", "runs", run_path="latest")
    command("export", _export, "input", "runs", "output", run_path="latest")
    command("query", _query, "tables", "output").add_argument("name", choices=sorted(registry.QUERIES))
    return parser, commands.choices


def _with_settings(parser: argparse.ArgumentParser, commands: dict[str, argparse.ArgumentParser], argv: list[str] | None) -> argparse.Namespace:
    known = argparse.ArgumentParser(add_help=False)
    known.add_argument("--settings")
    path = known.parse_known_args(argv)[0].settings
    for name, section in (files.load_settings(path) if path else {}).items():
        if name not in commands:
            continue  # a section of something else
        given = {k.replace("-", "_"): v for k, v in section.items()}
        for action in commands[name]._actions:
            if action.dest in given:
                action.required = False
        commands[name].set_defaults(**given)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = _with_settings(*_parser(), argv)
    args.run(_session(), args)


if __name__ == "__main__":
    main()
