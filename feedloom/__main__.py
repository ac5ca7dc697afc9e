"""python -m feedloom list | run QUERY FOLDER [OUTPUT]: names of the queries, or one of them over a folder of tables."""

from __future__ import annotations

import sys

from feedloom.runtime import session


def run(args: list[str]) -> int:
    from feedloom import queries

    if args[:1] == ["list"]:
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    if len(args) < 3 or args[0] != "run" or args[1] not in queries.QUERIES:
        print(__doc__)
        return 2
    found = queries.QUERIES[args[1]](session(), args[2])
    if len(args) > 3:
        found.write.mode("overwrite").parquet(args[3])
    else:
        found.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
