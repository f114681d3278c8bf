"""Imports every catalogue module, which fills the registry."""

import importlib
import pkgutil

import tidemark.catalog as _pkg
from tidemark.catalog.registry import JOBS, oracle_texts  # noqa: F401

for _module in sorted(m.name for m in pkgutil.iter_modules(_pkg.__path__)):
    if _module not in ("all", "registry", "views"):
        importlib.import_module(f"tidemark.catalog.{_module}")
