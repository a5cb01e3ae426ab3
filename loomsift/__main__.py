"""python -m loomsift check|fix|report|rules FILE... — exit codes 0, 1, 2 and 3 as in plans.api."""

from __future__ import annotations

import argparse
import json
import sys

from loomsift.plans import api
from loomsift.schema import MAX_SEQ_LEN
from loomsift.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomsift")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "fix", "report"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="+")
        c.add_argument("--format", default="auto", dest="shape")
        c.add_argument("--output")
        c.add_argument("--eval", dest="eval_path")
        c.add_argument("--disable", action="append", default=[])
        c.add_argument("--max-seq-len", type=int, default=MAX_SEQ_LEN)
        c.add_argument("--limit", type=int)
        c.add_argument("--baseline")
        c.add_argument("--markdown", action="store_true")
    commands.add_parser("rules")
    a = parser.parse_args(argv)
    if a.command == "rules":
        print(json.dumps(api.rule_list(), indent=1))
        return 0
    try:
        spark = local_session()
        if a.command == "check":
            result = api.check(spark, a.paths, a.shape, a.eval_path, a.disable, a.max_seq_len, a.output)
            print(json.dumps(result.to_dict(a.limit), default=str))
            return result.exit_code
        if a.command == "fix":
            fixed = api.fix(spark, a.paths, a.output, a.shape, a.eval_path, a.disable, a.max_seq_len)
            print(json.dumps(fixed.to_dict()))
            return fixed.exit_code
        baseline = None
        if a.baseline:
            with open(a.baseline) as f:
                baseline = json.load(f)
        summary = api.report(spark, a.paths, a.shape, a.max_seq_len, baseline)
        print(api.markdown(summary) if a.markdown else json.dumps(summary))
        return summary["exit_code"]
    except Exception as e:  # an operational failure is no finding
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
