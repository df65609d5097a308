"""Collects every query module."""

import importlib

from suite.registry import COVERS, ORACLES, QUERIES  # noqa: F401

for _module in ("q_names", "q_pixels", "q_pairs", "q_select", "q_control", "q_streams"):
    importlib.import_module(f"suite.{_module}")
