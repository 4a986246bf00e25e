"""python -m lakeweave COMMAND ...: ingest FILE | tickets SF_DIR OUT | cliques SF_DIR | migrate SF_DIR | sweep SF_DIR | same SF_DIR | fixture SF_DIR OUT | run QUERY SF_DIR | list."""

from __future__ import annotations

import sys

from .operators import manifest, tickets
from .plans import registry
from .session import session
from .sources import delimited


def main(args: list[str]) -> int:
    command, *rest = args or ["help"]
    if command == "list":
        print(*registry.QUERIES, sep="\n")
        return 0
    if command not in ("ingest", "tickets", "cliques", "migrate", "sweep", "same", "fixture", "run") or not rest:
        print(__doc__)
        return command != "help"
    spark = session()
    if command == "ingest":
        rows = delimited.cells(spark, rest[0])
        names = delimited.header(rows)
        print(names)
        delimited.repaired(rows, names).show(20, truncate=40)
        delimited.anomalies(rows, len(names)).groupBy("kind").count().show()
    elif command == "tickets":
        tickets.write(registry.all_tickets(spark, rest[0]), rest[1])
    elif command == "fixture":
        delimited.write(registry.messy(spark, rest[0]), rest[1])
    elif command == "sweep":
        found = manifest.sweep({"orders": (registry.messy(spark, rest[0]), manifest.Manifest.read(registry.MANIFEST), "o_orderkey")})
        for name, report in found.items():
            print(name, report)
        return int(not all(r["passed"] for r in found.values()))
    else:
        name, folder = {"cliques": ("cliques", rest[0]), "migrate": ("migration_report", rest[0]), "same": ("renamed_sources", rest[0])}.get(command) or (rest[0], rest[1])
        registry.QUERIES[name](spark, folder).show(50, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
