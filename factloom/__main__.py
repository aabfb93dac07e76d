"""``python -m factloom scan PATH``: runs the detectors over a source tree."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from .operators.collection import FactSet
from .plans import rules, scan
from .sources.code import open_repo
from .sources.documents import write_baseline, write_capture, write_sarif_log


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """The scan's exit code: 124 incomplete, 1 for findings as severe as ``--fail-on``, else 0."""
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("scan", help="run detectors over a source tree")
    run.add_argument("path")
    run.add_argument("--include", action="append", default=None, help="shell pattern of rule ids")
    run.add_argument("--exclude", action="append", default=None)
    run.add_argument("--fail-on", default="high")
    run.add_argument("--json", help="folder for the findings as JSON lines")
    run.add_argument("--sarif", help="folder for a SARIF log in parts")
    run.add_argument("--baseline", help="file folder to write the findings' fingerprints to")
    run.add_argument("--top", type=int, default=20, help="findings to list")
    commands.add_parser("rules", help="list the detectors")
    given = parser.parse_args(argv)
    if given.command == "rules":
        for d in rules.chosen():
            print(f"{d.rule_id}\t{d.severity}\t{d.description}")
        return 0
    layers = {"fail_on": given.fail_on} | ({"include": given.include} if given.include else {}) | ({"exclude": given.exclude} if given.exclude else {})
    config = scan.Config().merged(layers)
    session = spark or SparkSession.builder.appName("factloom").getOrCreate()
    folder = tempfile.mkdtemp(prefix="factloom-scan-") if spark is None and session.sparkContext.master.startswith("local[") else f"{_shared(session)}/scan"
    got = scan.scan(session, open_repo(session, given.path), rules.chosen(config.include, config.exclude), folder, config)
    if got.findings is not None:
        from pyspark.sql import functions as F

        found = got.findings.withColumn("suppressed_by", F.lit(None).cast("string"))
        print(FactSet(scan.overview(found), ("section", "place", "value")).tabulate(["section", "value", "n"]))
        print(FactSet(found, ("ord",)).tabulate(["severity", "rule_id", "file", "line", "summary"], given.top))
        for path, write in ((given.json, write_capture), (given.sarif, write_sarif_log), (given.baseline, write_baseline)):
            if path:
                write(found, path)
    for rule in got.incomplete:
        print(f"incomplete: {rule}", file=sys.stderr)
    return got.code(config.fail_on)


def _shared(spark: SparkSession) -> str:
    from .operators.graph import _shared as shared

    return shared(spark, "scan")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
