"""Vector collections and similarity search on Spark."""

from .functions.filters import Scope, Typed, compile_filter
from .operators.attr_index import AttrIndex
from .operators.collection import Collection, connect
from .operators.hnsw import Control
from .operators.maintenance import Alert, Rules, StatsView, diagnose
from .plans.placement import PlacementMap, located, rebalance_plan, rebalanced, shard_plan
from .sources.snapshot import Files, Head, Store
from .streaming.wal import AutoSave, LogFolder, fold, stream_fold
from .types import DimMismatch, HnswParams, IvfParams, Metric, Strategy

__all__ = [
    "Alert", "AttrIndex", "AutoSave", "Collection", "Control", "DimMismatch", "Files", "Head", "HnswParams", "IvfParams", "LogFolder", "Metric", "PlacementMap", "Rules", "Scope", "StatsView",
    "Store", "Strategy", "Typed", "compile_filter", "connect", "diagnose", "fold", "located", "rebalance_plan", "rebalanced", "shard_plan", "stream_fold",
]
