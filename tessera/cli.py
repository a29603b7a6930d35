"""Command line: process sources, dump reports, lint presets, start templates."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("process", help="run presets over a file, archive or folder")
    p.add_argument("source")
    p.add_argument("-p", "--preset", action="append", default=[], help="a preset or a folder of presets; may be repeated")
    p.add_argument("--profile", help="a saved list of presets")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--entity")
    p.add_argument("--linked-entity")
    p.add_argument("--config")
    p.add_argument("--local-zone")
    p.add_argument("--archive-depth", type=int)
    p.add_argument("--root-prefix-depth", type=int)
    p.add_argument("--split", action="store_true", default=None)
    p.add_argument("--no-source-columns", dest="source_columns", action="store_false", default=None)
    p.add_argument("--log-level")
    d = commands.add_parser("dump", help="write a nested report's models as tables")
    d.add_argument("report")
    d.add_argument("-o", "--output", required=True)
    d.add_argument("--models", nargs="*")
    lint = commands.add_parser("lint", help="check presets")
    lint.add_argument("paths", nargs="+")
    lint.add_argument("--strict", action="store_true")
    lint.add_argument("--advice", action="store_true")
    t = commands.add_parser("templates", help="start presets from artifact descriptions")
    t.add_argument("source")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("--tool", required=True)
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "lint":
        from .plans.lint import ADVICE, exit_code, lint_paths

        findings = lint_paths(args.paths)
        for f in findings:
            if args.advice or f.severity != ADVICE:
                print(f"{f.preset}: {f.severity}: {f.code}: {f.message} ({f.where})")
        return exit_code(findings, args.strict)
    if args.command == "templates":
        from .sources.templates import write_templates

        for path in write_templates(args.source, args.output, args.tool):
            print(path)
        return 0
    if args.command == "dump":
        from .operators.report import dump

        for name, rows in dump(_session(), args.report, args.output, args.models).items():
            print(f"{name}: {rows}")
        return 0
    from .api import process
    from .config import load_settings
    from .sources.sinks import load_profile

    settings = load_settings(
        args.config, local_zone=args.local_zone, archive_depth=args.archive_depth, root_prefix_depth=args.root_prefix_depth,
        split=args.split, source_columns=args.source_columns, log_level=args.log_level,
    )
    logging.basicConfig(level=settings.log_level, filename=settings.log_file)
    presets: list = [Path(p) for p in args.preset] + (load_profile(args.profile) if args.profile else [])
    if not presets:
        raise SystemExit("no presets given")
    result = process(_session(), args.source, presets, args.output, entity=args.entity, linked_entity=args.linked_entity, settings=settings)
    print(", ".join(f"{k}: {v}" for k, v in result.counts.items()))
    for w in result.warnings[:20]:
        print(f"warning: {w}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
