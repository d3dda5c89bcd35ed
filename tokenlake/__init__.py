"""tokenlake: Spark-native analytics for language-model operations data.

Telemetry reports (latency, throughput, inter-token gaps, GPU rollups),
fine-tuning corpus building (invoices, chat rendering, masks, splits,
contracts) and extraction evaluation, all as DataFrame / SQL /
Structured Streaming jobs.
"""

from tokenlake.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
