"""Web-crawl analytics as Spark jobs: extraction, URL dedup, frontier replay, telemetry."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
