"""Registered queries. Importing this package fills QUERIES and ORACLES."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import q_clean, q_frames, q_joins, q_metrics, q_models, q_profile, q_sources, q_splits  # noqa: F401
