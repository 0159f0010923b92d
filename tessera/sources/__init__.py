from tessera.sources.io import (read_table, read_pruned, write_parquet, write_partitioned,
                                write_relations, read_relations, profile)
from tessera.sources.views import TestData

__all__ = ["read_table", "read_pruned", "write_parquet", "write_partitioned",
           "write_relations", "read_relations", "profile", "TestData"]
