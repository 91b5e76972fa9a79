"""The actions at a shell: python -m quillspark check|fix|reflow|list-files|config [paths]."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import api, config, dictionaries
from .sources import project, readers, sinks


def arguments() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-r", "--recursive", action="store_true", help="go down folders and declared modules")
    common.add_argument("-s", "--skip-readme", action="store_true", help="leave readmes out")
    common.add_argument("-c", "--cfg", help="a file of settings")
    common.add_argument("paths", nargs="*")
    checks = argparse.ArgumentParser(add_help=False)
    checks.add_argument("--checkers", help="comma separated: hunspell, zspell, spellbook, nlprules, reflow")
    checks.add_argument("-d", "--dev-comments", action="store_true", help="developer comments too")
    checks.add_argument("-m", "--code", type=int, default=0, help="exit code if there are findings")
    checks.add_argument("--cache", help="a folder that keeps expanded dictionaries")
    top = argparse.ArgumentParser(prog="quillspark", description="Checks prose in comments and Markdown.")
    sub = top.add_subparsers(dest="action", required=True)
    sub.add_parser("check", parents=[common, checks], help="print findings")
    fix = sub.add_parser("fix", parents=[common, checks], help="put decided replacements into files")
    which = fix.add_mutually_exclusive_group(required=True)
    which.add_argument("--decisions", help="a CSV file: finding_id, choice, custom")
    which.add_argument("--ask", metavar="FILE", help="write the findings that need a decision to a CSV file, and change nothing")
    which.add_argument("--first", action="store_true", help="take the first replacement everywhere")
    sub.add_parser("reflow", parents=[common, checks], help="wrap paragraphs in files")
    sub.add_parser("list-files", parents=[common], help="print what would be checked")
    settings = sub.add_parser("config", help="print or write settings")
    settings.add_argument("-c", "--cfg", help="write to this file")
    settings.add_argument("-u", "--user", action="store_true", help="write to the user's file")
    settings.add_argument("--stdout", action="store_true", help="print")
    settings.add_argument("-o", "--overwrite", action="store_true")
    settings.add_argument("--filter", help="only these checkers")
    return top


def _config(args: argparse.Namespace) -> int:
    told = config.full()
    if args.filter:
        told = config.masked(told, args.filter)
    path = args.cfg or (config.user_path() if args.user else None)
    if path and not args.stdout:
        if args.overwrite and os.path.exists(path):
            os.unlink(path)
        config.write(told, path)
    elif args.stdout:
        print(config.to_toml(told), end="")
    else:
        raise SystemExit("config: one of --stdout, --user and --cfg is needed")
    return 0


def _settings(args: argparse.Namespace) -> config.Config:
    target = args.paths[0] if len(args.paths) == 1 and os.path.isdir(args.paths[0]) else None
    told = config.find(args.cfg, target, os.getcwd())
    width = told.reflow
    told = config.masked(told, getattr(args, "checkers", None))
    told.reflow = width or told.reflow  # its action needs its width, whichever checkers run
    told.dev_comments = told.dev_comments or getattr(args, "dev_comments", False)
    told.skip_readme = told.skip_readme or args.skip_readme
    return told


def _ask(found: DataFrame, path: str) -> None:
    """One file for a person to fill in: findings that have replacements, streamed through the driver."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["finding_id", "choice", "custom", "word", "replacements"])
        for r in found.filter(F.size("replacements") > 0).toLocalIterator():
            out.writerow([r.finding_id, "", "", r.word, " | ".join(r.replacements)])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.action == "config":
        return _config(args)
    told = _settings(args)
    found = project.extract(args.paths, args.recursive, told.skip_readme)
    if args.action == "list-files":
        for path in sorted([*found.rust, *found.markdown]):
            print(path)
        return 0
    if not found.rust and not found.markdown:
        return 0
    own = spark is None
    spark = spark or SparkSession.builder.appName("quillspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        origins = readers.from_project(spark, found)
        broken = 0
        for broken, r in enumerate(api.unreadable(origins).orderBy("origin_id").toLocalIterator(), 1):
            print(f"error: {r.origin_id}: {r.error}", file=sys.stderr)
        if broken:
            return 1
        if args.action == "reflow":
            print(f"{sinks.rewrite(origins, api.rewrapped(origins, told))} files rewritten")
            return 0
        ctx = dictionaries.context(spark, told, args.cache)
        findings = api.identified(api.check(origins, ctx))
        if args.action == "check":
            n = 0
            blocks = api.blocks(origins, findings).orderBy("origin_id", "start_line", "start_col", "end_line", "end_col")
            for n, r in enumerate(blocks.toLocalIterator(), 1):
                print(r.block, end="\n\n")
            return args.code if n else 0
        if args.ask:
            _ask(findings, args.ask)
            return 0
        if args.first:
            decisions = findings.select("finding_id", F.lit("1").alias("choice"), F.lit(None).cast("string").alias("custom"))
        else:
            decisions = spark.read.csv(args.decisions, header=True).select("finding_id", "choice", "custom")
        print(f"{sinks.rewrite(origins, api.fix(origins, findings, decisions))} files rewritten")
        return 0
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
