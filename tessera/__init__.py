"""tessera: session, hypergraph and ranking analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames; the heavy lifting is done by Spark SQL
expressions, windows, joins and aggregations so that Catalyst can prune, push down
and plan the shuffles.  Graph objects are long tables keyed by ``graph_id``.
"""

from tessera.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"
