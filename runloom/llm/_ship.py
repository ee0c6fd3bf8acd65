"""Send kernel modules to Python workers by value, so that executors need no copy of this package on their path."""

from __future__ import annotations

from types import ModuleType

from pyspark import cloudpickle


def by_value(*modules: ModuleType) -> None:
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
