"""relweave: relational feature synthesis and task-table analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from relweave.model import ColumnMeta, ForeignKey, RelationalDataset, TableMeta, TaskMeta
from relweave.session import tune

# functions used inside tasks travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ColumnMeta", "ForeignKey", "RelationalDataset", "TableMeta", "TaskMeta", "tune"]
