"""Attestra: identity-fraud analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from attestra.policy import Policy, Skew

# The few Python functions that run in tasks travel with the plan, so that executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Policy", "Skew"]
