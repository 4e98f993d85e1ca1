"""Command line: stats, check, report and folders."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from gaugeworks import __version__


def _table(title: str, rows, columns) -> None:
    print(f"\n{title}")
    widths = [max(len(c), *(len(str(r.get(c, ""))) for r in rows)) if rows else len(c) for c in columns]
    for r in [dict(zip(columns, columns)), *rows]:
        print("  ".join(str(r.get(c, "")).ljust(w) for c, w in zip(columns, widths)))


def _stats(spark, a) -> dict:
    from gaugeworks.plans.recipes import dataset_section
    from gaugeworks.sources.coco import read_coco

    out = dataset_section(read_coco(spark, a.annotations), a.tail_pct)
    print(f"images {out['num_images']}, categories {out['num_categories']}, annotations {out['num_annotations']}")
    _table("Imbalance", [{"metric": k, "value": "n/a" if v is None else v} for k, v in out["class_imbalance"].items()], ("metric", "value"))
    _table("Most frequent classes", out["class_distribution"][:20], ("name", "n", "fraction"))
    return out


def _check(spark, a) -> dict:
    from gaugeworks.operators.checks import all_issues, check_report
    from gaugeworks.sources.coco import read_coco

    out = check_report(all_issues(read_coco(spark, a.annotations), a.min_bbox_area, a.max_iou).persist())
    print(f"issues {out['total_issues']}")
    _table("By type", [{"type": k, "n": v} for k, v in out["by_type"].items()], ("type", "n"))
    _table("By severity", [{"severity": k, "n": v} for k, v in out["by_severity"].items()], ("severity", "n"))
    return out


def _report(spark, a) -> dict:
    from gaugeworks.plans.recipes import audit_file

    return audit_file(spark, a.annotations, a.name, tail_percentile=a.tail_pct, report_dir=a.output)


def _folders(spark, a) -> dict:
    from gaugeworks.plans.recipes import audit_folders

    return audit_folders(spark, a.root, a.name, a.max_per_class, report_dir=a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugeworks", description="Audits labelled image datasets.")
    p.add_argument("--version", action="version", version=__version__)
    commands = p.add_subparsers(required=True)

    def command(name: str, run, what: str, argument: str):
        c = commands.add_parser(name, help=what)
        c.set_defaults(run=run)
        c.add_argument(argument)
        c.add_argument("-o", "--output")
        return c

    command("stats", _stats, "statistics of an annotation file", "annotations").add_argument("--tail-pct", type=float, default=10.0)
    c = command("check", _check, "integrity checks of an annotation file", "annotations")
    c.add_argument("--min-bbox-area", type=float, default=4.0)
    c.add_argument("--max-iou", type=float, default=0.85)
    c = command("report", _report, "full audit of an annotation file", "annotations")
    c.add_argument("-n", "--name", default="dataset")
    c.add_argument("--tail-pct", type=float, default=10.0)
    c = command("folders", _folders, "statistics of a class-per-folder tree", "root")
    c.add_argument("-n", "--name", default="folders")
    c.add_argument("--max-per-class", type=int)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from gaugeworks.session import local_session

        spark = local_session()
    out = a.run(spark, a)
    if a.output and a.run in (_stats, _check):
        Path(a.output).parent.mkdir(parents=True, exist_ok=True)
        Path(a.output).write_text(json.dumps(out, indent=2, default=str), encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
