"""Analytics over edge-list files from the command line.

    python -m graphloom.cli ANALYTIC -i INPUT -o OUTPUT [-d DELIMITER] [--ca key=value] [--config FILE] ...

Analytics on numeric rules: wcc, wcc_min, lc, pr, pr_library, hbse, louvain, neighboringCommunities. On text rules, with
lenient parsing: text:wcc, text:lc, text:pr, text:hbse, text:louvain. Names and keys of ids are kept in all results.
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import config
from graphloom.operators import betweenness, components, leaf, louvain, neighbors, pagerank
from graphloom.session import session
from graphloom.sinks import text
from graphloom.sources.edge_text import read_lines, strict_edges, tokenized_edges

ALIASES = {"wccGraphX": "wcc_min", "prGraphX": "pr_library"}
NUMERIC = ("wcc", "wcc_min", "lc", "pr", "pr_library", "hbse", "louvain", "neighboringCommunities")
TEXT = ("text:wcc", "text:lc", "text:pr", "text:hbse", "text:louvain")
log = logging.getLogger("graphloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", exit_on_error=False)
    p.add_argument("analytic")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-d", "--delimiter", default=",")
    p.add_argument("-m", "--master", default=None)
    p.add_argument("-s", "--home", default=None)
    p.add_argument("-n", "--name", default="Graph Analytic")
    p.add_argument("-j", "--jars", default="")
    p.add_argument("-k", "--kryo", action="store_true")
    p.add_argument("-q", "--queue", default=None)
    p.add_argument("-w", "--workers", type=int, default=None)
    p.add_argument("--ca", action="append", help="key=value for the analytic")
    p.add_argument("-D", "--S", dest="system", action="append", help="key=value for the session")
    p.add_argument("--config", help="XML file of settings")
    p.add_argument("--timestamp", action="store_true", help="write below a folder named by the time")
    p.add_argument("--names-to-numbers", action="store_true", help="ids are numbers and compared as such")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """The arguments; anything missing or unknown is a ValueError."""
    try:
        args = parser().parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        raise ValueError(f"bad arguments: {e}") from e
    args.analytic = ALIASES.get(args.analytic, args.analytic)
    if args.analytic not in NUMERIC + TEXT:
        raise ValueError(f"unknown analytic: {args.analytic}")
    return args


def settings_of(args: argparse.Namespace) -> config.Settings:
    defaults = config.Settings(custom={
        "minProgress": "2000", "progressCounter": "1", "delta": "0.001", "parallelism": "-1", "community.split": ":", "damping.factor": "0.85",
        "minimum.progress": "2000", "progress.tries": "1", "simple.edge.delimiter": args.delimiter, "io.edge.reverse.duplicator": "false",
        "simple.edge.column.ignore": "false", "edge.delimiter": ",", "write.vertex.value": "true" if args.analytic == "text:wcc" else "false",
        "write.edge.value": "false", "log.level": "INFO",
    })
    file = config.parse_xml(open(args.config, encoding="utf-8").read()) if args.config else config.Settings()
    line = config.Settings(custom=config.pairs(args.ca), system=config.pairs(args.system))
    if args.workers is not None:
        line.engine["w"] = str(args.workers)
    return config.layered(defaults, file, line)


def _hbse(custom: dict[str, str], edges: DataFrame, ties: str, **base) -> betweenness.HighBetweenness:
    names = {
        "k": "betweenness.set.maxSize", "stability": "betweenness.set.stability", "stability_count": "betweenness.set.stability.counter",
        "batch": "pivot.batch.size", "most_pivots": "vertex.count", "seed": "pivot.batch.random.seed",
    }
    given = {k: int(custom[v]) for k, v in names.items() if v in custom}
    return betweenness.high_betweenness(edges, ties=ties, **{**base, **given})


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """Run the analytic and write its result; returns the folder."""
    conf = settings_of(args).custom
    logging.getLogger("graphloom").setLevel(conf["log.level"])
    base = conf.get("hdfs.url", "") + args.output
    out = text.run_folder(base) if args.timestamp else base.rstrip("/")
    lines = read_lines(spark, args.input, int(conf["parallelism"]))
    began, analytic = time.time(), args.analytic
    if analytic in NUMERIC:
        edges = strict_edges(lines, args.delimiter)
        # ids compare as numbers where all of them are; one pass tells
        texts = F.count(F.when(F.col("src").try_cast("bigint").isNull() | F.col("dst").try_cast("bigint").isNull(), 1))
        if args.names_to_numbers or not edges.agg(texts.alias("n")).first().n:
            edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "weight")
        moves = {"min_progress": int(conf["minProgress"]), "progress_counter": int(conf["progressCounter"])}
        if analytic in ("wcc", "wcc_min"):
            text.write(text.component_lines(edges, components.components(edges, "min" if analytic == "wcc_min" else "max"), args.delimiter), out)
        elif analytic == "lc":
            text.write(text.edge_lines(leaf.leaf_compression(edges), args.delimiter), out)
        elif analytic in ("pr", "pr_library"):
            rank = pagerank.pagerank_delta if analytic == "pr" else pagerank.pagerank_library
            text.write(text.vertex_lines(rank(edges, float(conf["delta"])), "rank", args.delimiter), out)
        elif analytic == "hbse":
            text.write_high_betweenness(_hbse(conf, edges, conf.get("ties", "all")), out, args.delimiter)
        elif analytic == "neighboringCommunities":
            text.write(text.neighbor_lines(neighbors.neighboring_communities(edges, **moves), args.delimiter, conf["community.split"]), out)
        else:
            q: list[float] = []

            def save(i: int, level: louvain.Level) -> None:
                q.append(level.q)
                text.write_level(i, level, out, q)

            louvain.louvain(edges, save=save, **moves)
    else:
        numeric_weight = analytic == "text:louvain"
        edges = tokenized_edges(
            lines, conf["simple.edge.delimiter"], "long" if numeric_weight else "text", conf.get("simple.edge.value.default"),
            conf["simple.edge.column.ignore"] == "true", conf["io.edge.reverse.duplicator"] == "true",
        )
        sink = {"delimiter": conf["edge.delimiter"], "write_vertex_value": conf["write.vertex.value"] == "true", "write_edge_value": conf["write.edge.value"] == "true"}
        if analytic == "text:wcc":
            labels = components.components_text(edges).withColumnRenamed("component", "value")
            text.write(text.configurable_edge_lines(edges, labels, **sink), out)
        elif analytic == "text:lc":
            left, nodes = leaf.leaf_folding(edges)
            text.write(text.configurable_edge_lines(left, nodes, **sink), out)
        elif analytic == "text:pr":
            ranks = pagerank.pagerank_power(edges, float(conf["damping.factor"])).withColumnRenamed("rank", "value")
            text.write(text.tab_vertex_lines(ranks, "value"), out)
        elif analytic == "text:hbse":
            weighted = edges.select("src", "dst", F.coalesce(F.col("value").try_cast("bigint"), F.lit(1)).alias("weight"))
            found = _hbse(conf, weighted, "all", batch=10, most_pivots=5, stability_count=1, reset_stability=True)
            text.write(text.tab_vertex_lines(found.betweenness, "betweenness"), out)
            text.write_set_and_stats(found, text.betweenness_stats(found, {k: v for k, v in conf.items() if "betweenness" in k or "pivot" in k}, time.time() - began), out + "_stats")
        else:
            weighted = edges.withColumnRenamed("value", "weight")
            found = louvain.louvain(weighted, rules=louvain.TEXT, min_progress=int(conf["minimum.progress"]), progress_counter=int(conf["progress.tries"]))
            for i, lv in enumerate(found.levels):
                text.write(text.community_vertex_lines(lv.vertices, lv.edges), f"{out}/stage_{i}")
                text.write(spark.createDataFrame([(str(lv.q),)], "value string"), f"{out}/_q_{i}", single=True)
            text.write(spark.createDataFrame([(str(found.levels[-1].q),)], "value string"), f"{out}/_COMPLETE", single=True)
            if len(found.levels) > 1:
                text.write(text.dendrogram_lines(louvain.dendrogram([lv.vertices for lv in found.levels])), f"{out}/table")
    log.info("Time in seconds: %.1f", time.time() - began)
    return out


def main(argv: list[str] | None = None) -> int:
    import sys

    logging.basicConfig()
    args = parse(sys.argv[1:] if argv is None else argv)
    conf = {k.replace(".", "__"): v for k, v in settings_of(args).system.items() if k.startswith("spark.")}
    if args.kryo:
        conf["spark__serializer"] = "org.apache.spark.serializer.KryoSerializer"
    if args.workers is not None:
        conf.setdefault("spark__executor__instances", str(args.workers))
    if args.jars:
        conf["spark__jars"] = args.jars
    if args.home:
        conf["spark__home"] = args.home
    if args.queue:
        conf["spark__yarn__queue"] = args.queue
    run(session(args.name, args.master, **conf), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
