"""weftgraph: sequences and pairwise alignments to a variation graph, as Spark jobs."""

__version__ = "0.3.0"
