"""Command line: ``python -m weftgraph -s SEQUENCES -p PAF[:K],... -g OUT``."""

from __future__ import annotations

import argparse
import sys
import time

from weftgraph import version
from weftgraph.functions.text import alignment_list, handy_number
from weftgraph.operators.graph import BrokenGraph
from weftgraph.operators.sequences import DuplicateNames
from weftgraph.plans.induce import induce_files
from weftgraph.plans.work import telling
from weftgraph.session import session
from weftgraph.sources.lines import exists


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: usage, repeated names or a broken graph; 2: no sequences; 4: no alignments."""
    p = argparse.ArgumentParser(prog="weftgraph", exit_on_error=False)
    p.add_argument("-p", "--paf-alns", required=True)
    p.add_argument("-s", "--seqs", required=True)
    p.add_argument("-g", "--gfa")
    p.add_argument("-k", "--min-match-len", type=int, default=0)
    p.add_argument("-f", "--sparse-factor", type=float, default=0.0)
    p.add_argument("-r", "--repeat-max", type=int, default=0)
    p.add_argument("-l", "--min-repeat-distance", type=int, default=0)
    p.add_argument("-B", "--transclose-batch", default="1M", help="accepted; changes no result")
    p.add_argument("-b", "--temp-dir", help="folder of the work tables; all executors must share it")
    p.add_argument("-T", "--keep-temp", action="store_true", help="accepted: work tables are Spark's and go when it ends")
    p.add_argument("-P", "--show-progress", action="store_true", help="say on stderr what is done")
    p.add_argument("-V", "--verbose-debug", action="store_true", help="with the sizes of the tables, and some rows of each")
    p.add_argument("-t", "--threads", type=int, default=0, help="local threads; 0: as the session is set")
    p.add_argument("--on-bad-row", choices=("stop", "skip", "raise"), default="stop")
    p.add_argument("-v", "--version", action="version", version=version.short())
    try:
        a = p.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        return 0 if getattr(e, "code", 1) == 0 else 1
    handy_number(a.transclose_batch, 1e6)
    spark = session(master=f"local[{a.threads}]" if a.threads else None)
    if a.temp_dir:
        spark.conf.set("spark.checkpoint.dir", a.temp_dir)
    say = (lambda text: print(text, file=sys.stderr)) if a.show_progress or a.verbose_debug else (lambda text: None)
    if not exists(spark, a.seqs):
        return 2
    if not all(exists(spark, path) for path, _ in alignment_list(a.paf_alns)):
        return 4
    say("inducing the graph")
    began = time.monotonic()
    try:
        with telling(lambda text: say(f"[{time.monotonic() - began:.1f} s] {text}")):
            g = induce_files(spark, a.seqs, a.paf_alns, a.on_bad_row, min_match_len=a.min_match_len, sparse_factor=a.sparse_factor, repeat_max=a.repeat_max, min_repeat_dist=a.min_repeat_distance)
    except (DuplicateNames, BrokenGraph) as e:
        print(e, file=sys.stderr)
        return 1
    if a.show_progress or a.verbose_debug:
        say(f"{g.seen['graph_bases']} graph bases of {g.seen['bases_seen']}, {g.seen['nodes']} nodes, {g.links.count()} links")
    if a.verbose_debug:
        for name in ("matches", "intervals", "nodes", "links"):
            say(f"{name}: {[tuple(r) for r in getattr(g, name).limit(5).collect()]}")
    if a.gfa:
        g.write_gfa(a.gfa)
    else:
        for r in g.gfa.orderBy("kind", "k1", "k2", "k3", "k4").select("line").toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
