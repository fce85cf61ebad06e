"""Connected components, their rounds checkpointed as the training-data operators do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hazgrid.llm.common import checkpointed
from hazgrid.operators import stars


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is the least node reachable."""
    return stars.connected_components(edges, checkpointed)
