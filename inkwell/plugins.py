"""Converters from other packages: registered by hand or found through entry points, used only if asked for."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from inkwell.operators.routing import Registry

INTERFACE_VERSION = 1
GROUP = "inkwell.plugins"
_registered: list[Callable[[Registry], None]] = []


def register(plugin: Callable[[Registry], None]) -> None:
    """A plugin gets the registry and adds its routes and converters."""
    _registered.append(plugin)


def registered() -> list[Callable[[Registry], None]]:
    return list(_registered)


def clear() -> None:
    _registered.clear()


def discover() -> tuple[dict[str, Callable[[Registry], None]], list[str]]:
    """Plugins of installed packages by name, each once, and what went wrong while loading others."""
    found, errors = {}, []
    for point in sorted(entry_points(group=GROUP), key=lambda p: (p.value, p.name)):
        if point.name in found:
            continue
        try:
            found[point.name] = point.load()
        except Exception as e:  # noqa: BLE001  a broken package must not stop the others
            errors.append(f"{point.name}: {type(e).__name__}: {e}")
    return found, errors


def enabled(use_plugins: bool = False) -> tuple[Registry, list[str]]:
    """A registry with the built-in converters and, if asked for, all plugins; those that fail are skipped and named."""
    registry, errors = Registry(), []
    if use_plugins:
        found, errors = discover()
        for plugin in [*_registered, *found.values()]:
            routes, converters = list(registry.routes), dict(registry.converters)
            try:
                plugin(registry)
            except Exception as e:  # noqa: BLE001
                registry.routes, registry.converters = routes, converters
                errors.append(f"{getattr(plugin, '__name__', plugin)}: {type(e).__name__}: {e}")
    return registry, errors
