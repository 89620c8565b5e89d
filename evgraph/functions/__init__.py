"""Column functions of the graph model."""

from evgraph.functions.columns import *  # noqa: F403
