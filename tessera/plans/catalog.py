"""Import every query module so that the registry is filled."""

from tessera.plans import q_sessions  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
from tessera.plans import q_prep  # noqa: F401,E402
from tessera.plans import q_samples  # noqa: F401,E402
from tessera.plans import q_graph  # noqa: F401,E402
from tessera.plans import q_spectral  # noqa: F401,E402
from tessera.plans import q_features  # noqa: F401,E402
from tessera.plans import q_io  # noqa: F401,E402
