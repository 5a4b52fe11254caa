"""Spark-native operators for keeping the books on a text training corpus.

Every operator is a function ``DataFrame(s) -> DataFrame``; nothing is collected to the driver.

Subpackages:

- ``sources``   schemas, readers/writers, fixture views over the driver tables
- ``functions`` column-level helpers (tokenizer pattern, hashing, distributed ranks)
- ``operators`` ledger changes, queries, run tables, audits, tokenizer, metrics
- ``plans``     multi-step jobs composed from operators
- ``streaming`` Structured Streaming ledger apply
"""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["session"]
