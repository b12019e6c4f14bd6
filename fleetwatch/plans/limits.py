"""Limits for the test tables, whose pods are all alike: every rule that can flag a pod on all rows does so."""

from __future__ import annotations

from fleetwatch.operators.detector import Thresholds

KEEN = Thresholds(level_cut=1.5, axis_cut=0.02, flat_share=0.97, high_minutes=1, shape_cut=0.0)
