"""Command line: python -m quarrylight PATH..."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quarrylight", description="Scan source files for weaknesses.")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("-f", "--format", default="text", choices=["text", "json", "sarif", "html"])
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--rules", type=lambda s: s.split(","))
    p.add_argument("-s", "--severity")
    p.add_argument("-c", "--confidence")
    p.add_argument("-e", "--extensions", type=lambda s: s.split(","), default=[])
    p.add_argument("-x", "--exclude", type=lambda s: s.split(","), default=[], help="in addition to the usual ones")
    p.add_argument("--max-size", type=int, default=10 * 1024 * 1024)
    for flag in ("--no-entropy", "--no-deps", "--no-triage", "--incremental", "--clear-cache", "--cache-stats", "--git-aware", "--triage-stats", "--list-rules", "--rule-summary", "--watch"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--git-base", default="HEAD")
    p.add_argument("--diff", metavar="REVISION")
    p.add_argument("--init-rules", metavar="FOLDER")
    p.add_argument("--rule-folder")
    p.add_argument("--state", default=".quarrylight")
    p.add_argument("--advisories", metavar="PATH", help="a table of advisories (JSON lines) in place of the built-in list")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from . import api, sinks
    from .plans import diff
    from .plans.scan import ScanOptions
    from .sources import files, rules
    from .streaming import watch

    try:
        if a.init_rules:
            print("\n".join(rules.write_examples(a.init_rules)))
            return 0
        spark = SparkSession.builder.appName("quarrylight").getOrCreate()
        o = ScanOptions(rules=a.rules, severity=a.severity, confidence=a.confidence, extensions=tuple(a.extensions), exclude=tuple(a.exclude), max_size=a.max_size,
                        entropy=not a.no_entropy, deps=not a.no_deps, custom=tuple(rules.load(a.rule_folder)) if a.rule_folder else ())
        if a.list_rules or a.rule_summary:
            (api.list_rules(spark) if a.list_rules else api.rule_summary(spark)).show(100, False)
            return 0
        if a.clear_cache:
            api.clear_cache(a.state)
        if a.cache_stats or a.triage_stats:
            (api.cache_stats(spark, a.state) if a.cache_stats else api.triage_stats(api.read_verdicts(spark, a.state))).show(truncate=False)
            return 0
        if a.diff:
            d = api.diff(spark, a.paths[0], a.diff, o)
            print(diff.report(d))
            return int(d.where("classification = 'introduced'").limit(1).count() > 0)
        if a.watch:
            watch.watch(watch.of_folder(spark, a.paths[0]), a.state, lambda df, n: df.show(truncate=False), o).awaitTermination()
            return 0
        verdicts = None if a.no_triage else api.read_verdicts(spark, a.state)
        source = files.of_paths(spark, a.paths, extensions=o.extensions, exclude=o.exclude, max_size=o.max_size)
        if a.git_aware:
            source = source.join(files.changed_files(spark, a.paths[0], a.git_base), "file", "left_semi")
        advisories = api.read_advisories(spark, a.advisories) if a.advisories else None
        found = api.scan_incremental(source, a.state, o) if a.incremental else api.scan(source, o, verdicts, advisories)
        found = found.persist()
        try:
            if a.output:
                sinks.export(found, a.format, a.output)
            else:
                print(sinks.FORMATS[a.format](found))
            return sinks.exit_code(found)
        finally:
            found.unpersist()
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
