"""Command line: validate, stats, diff, patch, extract, list the queries, run one.

python -m bankspark validate BANK | stats BANK | diff OLD NEW | patch BANK OPERATIONS | extract BANK TEXT | queries | run QUERY TABLES
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from bankspark.operators import bank as banks
from bankspark.operators import scan as scans


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    command, *rest = args
    show = lambda value: print(json.dumps(value, ensure_ascii=False, indent=2))
    if command == "validate":
        found = banks.validate(banks.read_bank(rest[0], check=False))
        show(found)
        return int(any(d["severity"] == "error" for d in found))
    if command == "stats":
        show(banks.stats(banks.read_bank(rest[0])))
    elif command == "diff":
        show(banks.diff(banks.read_bank(rest[0]), banks.read_bank(rest[1])))
    elif command == "patch":
        show(banks.patch(banks.read_bank(rest[0]), banks.strict_json(Path(rest[1]).read_text(encoding="utf-8"))))
    elif command == "extract":
        show(scans.scan_text(rest[1], scans.detectors(banks.read_bank(rest[0]))))
    elif command in ("queries", "run"):
        from bankspark.plans import registry

        known = {k: f for m in registry.modules() for k, f in m.QUERIES.items()}
        if command == "queries":
            print("\n".join(known))
            return 0
        from pyspark.sql import SparkSession

        known[rest[0]](SparkSession.builder.getOrCreate(), rest[1]).show(50, False)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
