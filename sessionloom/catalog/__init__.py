"""All registered queries."""

import importlib
import pkgutil


def load():
    from sessionloom.catalog import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
