"""Every registered query with, where SQL can express it, the equivalent statement for the check engine."""

from __future__ import annotations

import importlib

MODULES = ["calibrate", "cells", "correlated", "curves", "exact", "fits", "modes", "presets", "relate", "sourcing", "spectra", "strategies"]


def entries() -> dict:
    out: dict = {}
    for name in MODULES:
        part = importlib.import_module(f"crossfactor.registry.{name}").ENTRIES
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out
