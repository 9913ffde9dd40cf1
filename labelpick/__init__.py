"""Choose which rows of a large embedding table to label, and learn from those labels, on Spark."""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from labelpick.operators.select import SelectionResult, select_density, select_rows  # noqa: E402
from labelpick.sources.tables import as_points  # noqa: E402

__all__ = ["SelectionResult", "as_points", "select_density", "select_rows"]
