"""Command line: index a folder of specs, and ask a stored index. Results are printed as JSON lines.

    python -m specloom.cli index SPECS --index-path DIR [--level L2] [--domain D]
    python -m specloom.cli search TEXT --index-path DIR [--min-score 0.3] [-n 10] [--kind K] [--no-embeddings]
    graph ROOT | impact NODE | semantic TEXT | coverage NODE | violations | orphan-edges | context HINT... | list | stats | section FILE
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import HashingEncoder
from .operators import extract, retrieval
from .operators import graph as G
from .sources import store

DIMENSIONS = 64


def _show(df: DataFrame, *order, **also) -> None:
    """Rows of a bounded answer, streamed to standard output."""
    for row in df.orderBy(*order).toJSON().toLocalIterator() if order else df.toJSON().toLocalIterator():
        print(row)
    for k, v in also.items():
        if v:
            print(json.dumps({k: v}, ensure_ascii=False))


def _graph(spark: SparkSession, path: str, embeddings: bool = False):
    opened = store.open_index(spark, path, skip_embeddings=not embeddings)
    return G.build(opened.nodes, opened.edges), opened


def _index(spark: SparkSession, a) -> None:
    level = a.level if a.level == "L1" else "L2"
    made = extract.index(store.spec_files(spark, a.specs, unread=True), level, HashingEncoder(DIMENSIONS), "hashing", DIMENSIONS, a.domain)
    made.nodes, made.edges = made.nodes.persist(), made.edges.persist()
    commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip() or None
    manifest = store.manifest_of(made, level, "hashing", DIMENSIONS, [a.domain] if a.domain else [], commit)
    store.save(made, a.index_path, manifest)
    _show(made.log, "source_path")
    _show(manifest)


def _search(spark, a) -> None:
    g, o = _graph(spark, a.index_path, not a.no_embeddings)
    r = retrieval.hybrid(g, o.embeddings, a.text, HashingEncoder(DIMENSIONS), kinds=a.kind, min_score=a.min_score, limit=a.n)
    _show(r.results, "rank", warnings=r.warnings)


def _related(spark, a) -> None:
    r = retrieval.related(_graph(spark, a.index_path)[0], a.node, a.depth, kinds=a.kind)
    _show(r.nodes, F.desc("score"), "node_id")


def _impact(spark, a) -> None:
    i = retrieval.impact(_graph(spark, a.index_path)[0], a.node, depth=a.depth)
    for part in (i.direct, i.transitive, i.scenarios):
        _show(part, "node_id")
    print(json.dumps({"truncated": i.truncated}))


def _semantic(spark, a) -> None:
    g, o = _graph(spark, a.index_path, True)
    if o.embeddings is None:
        sys.exit("the index has no embeddings")
    _show(retrieval.semantic(g, o.embeddings, a.text, HashingEncoder(DIMENSIONS), a.min_score, a.n, a.kind), F.desc("score"), "node_id")


def _coverage(spark, a) -> None:
    g = _graph(spark, a.index_path)[0]
    c = retrieval.coverage(g, a.node)
    _show(c, "category_rank")
    _show(retrieval.coverage_links(g, a.node), "category", "other")
    _show(retrieval.coverage_percent(c))


def _violations(spark, a) -> None:
    g = _graph(spark, a.index_path)[0]
    v = retrieval.layer_violations(g, a.kind, a.layer)
    _show(v, "from_node", "to_node")
    _show(retrieval.rate(v, g.edges, "violations"))


def _orphans(spark, a) -> None:
    g = _graph(spark, a.index_path)[0]
    o = retrieval.orphan_edges(g, a.edge_type)
    _show(o, "from_node", "to_node")
    _show(retrieval.rate(o, g.edges.select("edge_type").unionByName(g.orphans.select("edge_type")), "orphans"))


def _context(spark, a) -> None:
    c = retrieval.context(_graph(spark, a.index_path)[0], a.hints, a.depth, a.max_tokens)
    _show(c.constraints.unionByName(c.behavior), "rank", warnings=c.warnings)


def _list(spark, a) -> None:
    _show(retrieval.listing(_graph(spark, a.index_path)[0].nodes, a.kind, a.domain), "id")


def _stats(spark, a) -> None:
    g, o = _graph(spark, a.index_path, True)
    print(json.dumps(o.manifest, default=str, ensure_ascii=False))
    _show(retrieval.stats(g, o.embeddings if o.embeddings is not None else g.nodes.limit(0)))


def _section(spark, a) -> None:
    print(store.read_section(spark, a.specs, a.file, a.anchor))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specloom")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *args, **options):
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x, nargs="+" if x == "hints" else None)
        if name != "section":
            s.add_argument("--index-path", default=".index")
        for flag, kw in options.items():
            s.add_argument(("-" if len(flag) == 1 else "--") + flag.replace("_", "-"), **kw)
        s.set_defaults(run=run)

    kind = {"kind": {"action": "append"}}
    command("index", _index, "specs", domain={}, level={"default": "L2"})
    command("search", _search, "text", min_score={"type": float, "default": 0.3}, n={"type": int, "default": 10}, no_embeddings={"action": "store_true"}, **kind)
    command("find-spec", lambda s, a: _show(retrieval.find_spec(*((lambda g, o: (g, o.embeddings))(*_graph(s, a.index_path, True))), a.text, HashingEncoder(DIMENSIONS)).results, "rank"), "text")
    command("graph", _related, "node", depth={"type": int, "default": 2}, **kind)
    command("impact", _impact, "node", depth={"type": int, "default": 3})
    command("semantic", _semantic, "text", min_score={"type": float, "default": 0.7}, n={"type": int, "default": 10}, **kind)
    command("coverage", _coverage, "node")
    command("violations", _violations, layer={"action": "append"}, **kind)
    command("orphan-edges", _orphans, edge_type={"action": "append"})
    command("context", _context, "hints", depth={"type": int, "default": 1}, max_tokens={"type": int, "default": 4000})
    command("list", _list, domain={}, **kind)
    command("stats", _stats)
    command("section", _section, "specs", "file", anchor={})
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("specloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        args.run(spark, args)
    except retrieval.QueryError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
