"""Imports every module that registers queries."""

import importlib
import pkgutil

from memspark import plans
from memspark.plans.registry import ORACLE, QUERIES

for _m in pkgutil.iter_modules(plans.__path__):
    if _m.name not in ("catalog", "registry", "views", "oracle_views"):
        importlib.import_module(f"memspark.plans.{_m.name}")

__all__ = ["ORACLE", "QUERIES"]
