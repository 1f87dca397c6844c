"""All registered queries; importing this package fills the registry."""

import importlib
import pkgutil

from regulus.catalog.registry import REGISTRY

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["REGISTRY"]
