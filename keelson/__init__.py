"""Keyed-log analytics on Spark: an append-only log of puts and deletes, reduced on demand."""

from keelson.operators.config import EngineConfig
from keelson.operators.manifest import Manifest, RunMeta
from keelson.operators.state import KeyedState

__all__ = ["EngineConfig", "KeyedState", "Manifest", "RunMeta"]
