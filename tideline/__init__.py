"""Lineage-aware batch and stream analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tideline.session import build_session, scratch_dir

# Python functions of this package travel to the executors with the job, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_dir"]
