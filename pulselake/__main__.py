"""python -m pulselake list | show NAME | query NAME DIR | analyze NAME FILE [key=value ...] [--out PATH]"""

from __future__ import annotations

import ast
import os
import sys


def main(args: list[str]) -> int:
    from . import api
    from .plans import catalog
    from .session import local_session

    out = args.pop(args.index("--out") + 1) if "--out" in args else None
    args = [a for a in args if a != "--out"]
    if args[:1] == ["list"]:
        print("\n".join(["queries:", *sorted(catalog.QUERIES), "operators:", *sorted(api.operators() | api.network_operators())]))
        return 0
    if args[:1] == ["show"] and len(args) == 2:
        print(api.parameters(args[1]))
        return 0
    if args[:1] not in (["query"], ["analyze"]) or len(args) < 3:
        print(__doc__)
        return 2
    spark = local_session("pulselake", cores=os.cpu_count() or 1)
    if args[0] == "query":
        df = catalog.run(args[1], spark, args[2])
    else:
        df = api.analyze(api.load(spark, args[2]), args[1], **{k: ast.literal_eval(v) for k, v in (a.split("=", 1) for a in args[3:])})
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
