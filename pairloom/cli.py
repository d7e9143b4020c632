"""Commands: select-frequency, materialize, promote, compare, catalog."""

from __future__ import annotations

import argparse
import json

from .config import DiscoverySettings, StreamSpec, load_yaml, parse_roots, strict
from .plans import pipeline
from .session import session
from .sources import catalog


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("select-frequency")
    c.add_argument("candidates"), c.add_argument("out"), c.add_argument("--budget", type=int, required=True)
    c = sub.add_parser("materialize")
    c.add_argument("selected"), c.add_argument("out"), c.add_argument("--selector", required=True)
    for name in ("size", "base", "buckets"):
        c.add_argument(f"--{name}", type=int, required=True)
    c = sub.add_parser("promote")
    c.add_argument("records"), c.add_argument("folder"), c.add_argument("--base", type=int, required=True), c.add_argument("--buckets", type=int, required=True)
    c.add_argument("--setting", action="append", default=[], help="NAME=VALUE")
    c = sub.add_parser("compare")
    c.add_argument("a"), c.add_argument("b"), c.add_argument("--resamples", type=int, default=10_000), c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("catalog")
    c.add_argument("config"), c.add_argument("out"), c.add_argument("--root", action="append", default=[])
    return p


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = session()
    if args.command == "select-frequency":
        print(json.dumps(pipeline.frequency_selection(spark, args.candidates, args.out, args.budget)))
    elif args.command == "materialize":
        pipeline.materialize_selection(spark, args.selected, args.base, args.buckets, args.selector, args.size).write.parquet(args.out)
    elif args.command == "promote":
        values = {k: (float(v) if "." in v or "e" in v else int(v)) for k, v in parse_roots(args.setting).items()}
        out = pipeline.discover_and_promote(spark.read.parquet(args.records), strict(DiscoverySettings, values), args.base, args.buckets, args.folder)
        print(out["audit"].toJSON().first())
    elif args.command == "compare":
        print(pipeline.compare_runs(spark, args.a, args.b, args.resamples, args.seed).toJSON().first())
    else:
        config = load_yaml(args.config, ("streams",))
        catalog.discover(spark, [strict(StreamSpec, s) for s in config["streams"]], parse_roots(args.root)).write.parquet(args.out)


if __name__ == "__main__":
    main()
