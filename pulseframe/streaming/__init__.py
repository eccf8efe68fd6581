"""Structured Streaming forms of the operators.

Sources are file folders (each file written once) or a Kafka topic when its
connector is on the classpath; offsets live in the checkpoint, so a
restarted query resumes where it stopped. Scoring uses fitted state only
(stateless per row); roll-ups carry a watermark so their state is bounded.
"""

from pulseframe.streaming.activity_stream import (  # noqa: F401
    activity_line_stream, dedup_events, event_stream, minute_rollup, refit_every, run_available,
    score_batches, score_stream, stream_to_table,
)
from pulseframe.streaming.group_stats import GroupStatistics, stream_group_count, stream_io_wait_count  # noqa: F401
