"""Panel, join, factor, graph, clustering and portfolio operators."""
