"""Training-data operators: language ID, mixing, near-duplicates, repeats, toxicity, HTML, fingerprints, URLs, tokens.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Executors get the code with the tasks, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
