"""Command line: `python -m effortlens COMMAND ...`, also for spark-submit."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.operators import commits, privacy, report
from effortlens.operators.classifier import BOOST_DEPTH, BOOST_ROUNDS
from effortlens.plans import jobs
from effortlens.session import spark_session
from effortlens.sources.csv import read_mods_many
from effortlens.sources.json import read_commits_json
from effortlens.sources.store import ModStore, load_email_map, save_email_map

NO_COMMITS = "no commits"


def month(text: str) -> tuple[int, int]:
    year, number = text.split("-")
    return int(year), int(number)


def _blame(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    return spark.read.parquet(args.blame) if args.blame else None


def _refresh(spark: SparkSession, args: argparse.Namespace) -> None:
    mods = jobs.read_mods(spark, args.mods, args.format)
    jobs.refresh(ModStore(spark, args.root, args.repository), mods, _blame(spark, args))


def _label(spark: SparkSession, args: argparse.Namespace) -> None:
    jobs.write_mods(jobs.label(ModStore(spark, args.root, args.repository)), args.labelled, args.format)


def _gmt(spark: SparkSession, args: argparse.Namespace) -> None:
    jobs.rewrite_in_gmt(spark, args.mods, args.target)


def _mine(spark: SparkSession, args: argparse.Namespace) -> None:
    mods = commits.explode_commits(read_commits_json(spark, args.commits, lines=args.lines))
    found = commits.scan_range(mods, args.first or commits.ALL, args.last)
    if commits.has_commits(found):
        jobs.write_mods(found, args.mods, args.format)
    else:
        print(NO_COMMITS)


def _anonymise(spark: SparkSession, args: argparse.Namespace) -> None:
    hidden, emails = privacy.anonymise(jobs.read_mods(spark, args.mods, args.format), args.drop_message)
    save_email_map(emails, args.emails)
    jobs.write_mods(hidden, args.hidden, args.format)


def _restore(spark: SparkSession, args: argparse.Namespace) -> None:
    scored = jobs.read_mods(spark, args.scored, args.format)
    jobs.write_mods(privacy.de_anonymise(scored, load_email_map(spark, args.emails)), args.restored, args.format)


def _train(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.format == "parquet":
        mods = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(spark.read.parquet, args.mods))
    else:
        mods = read_mods_many(spark, args.mods).drop("origin")
    jobs.train(mods, args.models, kind=args.classifier, rounds=args.rounds, depth=args.depth)


def _score(spark: SparkSession, args: argparse.Namespace) -> None:
    jobs.score_file(
        spark, args.hidden, args.scored, args.models, args.format, scaler=args.scaler, min_rows=args.min_rows
    )


def _restored(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return jobs.read_mods(spark, args.restored, args.format).withColumn("mod_score", F.col("mod_score").try_cast("double"))


def _cube(spark: SparkSession, args: argparse.Namespace) -> None:
    jobs.write_mods(report.score_cube(_restored(spark, args)), args.target, args.format)


def _series(spark: SparkSession, args: argparse.Namespace) -> None:
    series = report.month_series(
        _restored(spark, args), args.language, args.first, args.last, args.author, not args.exact
    )
    found = report.author_totals(series) if args.totals else report.long_series(series)
    jobs.write_mods(found, args.target, args.format)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="effortlens", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, summary: str, *paths: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=summary)
        for path in paths:
            sub.add_argument(path)
        sub.add_argument("--format", choices=jobs.FORMATS, default="csv", help="of the tables read and written")
        sub.set_defaults(run=run)
        return sub

    sub = command("mine", _mine, "nested commits (JSON) to mods (CSV)", "commits", "mods")
    sub.add_argument("--lines", action="store_true", help="one commit per line")
    sub.add_argument("--from", dest="first", help="first day, YYYY-MM-DD; all commits without it")
    sub.add_argument("--to", dest="last", help="last day")
    sub = command("refresh", _refresh, "add unseen mods to a store, or create it", "mods", "root", "repository")
    sub.add_argument("--blame", help="blame rows to add (Parquet)")
    command("label", _label, "bug labels for all mods of a store, newest first", "root", "repository", "labelled")
    sub = command("gmt", _gmt, "write CSV files again with dates in GMT", "target")
    sub.add_argument("mods", nargs="+")
    sub = command("anonymise", _anonymise, "hide personal columns", "mods", "emails", "hidden")
    sub.add_argument("--drop-message", action="store_true")
    command("restore", _restore, "put e-mails back", "scored", "emails", "restored")
    sub = command("train", _train, "fit and save models", "models")
    sub.add_argument("mods", nargs="+")
    sub.add_argument("--classifier", choices=("boosted", "forest"), default="boosted")
    sub.add_argument("--rounds", type=int, default=BOOST_ROUNDS, help="trees per class")
    sub.add_argument("--depth", type=int, default=BOOST_DEPTH)
    sub = command("score", _score, "score hidden mods", "hidden", "models", "scored")
    sub.add_argument("--scaler", choices=("target", "training"), default="target")
    sub.add_argument("--min-rows", type=int, default=0)
    command("cube", _cube, "scores by author, date and extension", "restored", "target")
    sub = command("series", _series, "month sums per author", "restored", "target")
    sub.add_argument("--language", required=True)
    sub.add_argument("--from", dest="first", type=month, required=True, help="YYYY-MM")
    sub.add_argument("--to", dest="last", type=month, required=True, help="YYYY-MM")
    sub.add_argument("--author", action="append", help="an e-mail; may be given several times")
    sub.add_argument("--exact", action="store_true", help="do not add up equal months of two years")
    sub.add_argument("--totals", action="store_true", help="one sum per author")
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(spark_session(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
