"""The command line: `python -m lodestone search "..."`, `debug`, `version`."""

from __future__ import annotations

import argparse
import sys

from lodestone import __version__
from lodestone.api import Index
from lodestone.options import DEFAULT_RADIUS, DEFAULT_TOP_K, SearchOptions
from lodestone.sources.scan import find_root


def label(hit: dict, reasons: bool = False) -> str:
    """A hit's heading: its path, and kind and name unless it is a whole file; with `reasons`, what it was found by."""
    out = hit["path"] if hit["kind"] == "file" else f"{hit['path']} [{hit['kind']}] {hit['name']}"
    found = [f"{name} {hit[key]:.4f}" for name, key in (("distance", "l2"), ("rank", "bm25")) if hit.get(key) is not None]
    return f"{out} ({', '.join(found)})" if reasons and found else out


def latency(times: dict[str, float], least: float = 0.001) -> str:
    """What a run spent its time on; parts under a millisecond are left out."""
    return ", ".join(f"{what} {seconds:.3f} s" for what, seconds in times.items() if seconds >= least)


def _radius(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 2:
        raise argparse.ArgumentTypeError("must be from 0 to 2")
    return value


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search", help="index the tree's changes, search it, print what is found")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=DEFAULT_TOP_K)
    s.add_argument("--radius", type=_radius, default=DEFAULT_RADIUS)
    s.add_argument("--no-semantic", dest="semantic", action="store_false")
    s.add_argument("--no-full-text", dest="full_text", action="store_false")
    s.add_argument("--rerank", action="store_true")
    s.add_argument("--cached-only", dest="refresh", action="store_false", help="search the index as it is")
    s.add_argument("--rebuild-vectors", action="store_true")
    s.add_argument("--stats", action="store_true")
    s.add_argument("--reasons", action="store_true", help="say by what each hit was found")
    for c in (s, commands.add_parser("debug", help="say what the index holds")):
        c.add_argument("--root", default=".")
        c.add_argument("--index", default=None)
    commands.add_parser("version")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    root = find_root(a.root)
    if root is None:
        print(f"{a.root} isn't inside a Git repository", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodestone").getOrCreate()
    index = Index(spark, root, a.index)
    if a.command == "debug":
        print(f"root {root}\nindex {index.store.path}\ngeneration {index.store.generation}")
        print("\n".join(f"{name} {n}" for name, n in index.counts().items()))
        return 0
    options = SearchOptions(a.query, a.top_k, a.radius, a.semantic, a.full_text, a.rerank, a.refresh, a.rebuild_vectors, a.stats)
    print("\n\n".join(f"{label(h, a.reasons)}\n{h['rendered']}" for h in index.render(options)))
    if a.stats:
        print(latency(index.times))
    return 0
