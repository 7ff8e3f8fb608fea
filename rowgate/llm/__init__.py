"""Operators for training-data pipelines: language ID, exact and near
deduplication, repeated-passage removal, top-k search, toxicity, token
counts, token output, source mixing, SentencePiece.

Nothing outside this subpackage imports it. Functions that run inside Python
workers are pickled by value, so executors need numpy, pyarrow and the
tokenizer libraries, but not this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
