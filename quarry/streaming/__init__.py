"""Structured Streaming entry points.

The reference has no streaming operators; its only incremental flow is the
top-k hypothesis file that grows batch by batch during decoding (A18). Here
that file is a parquet folder fed by ``sinks.append_hypotheses`` and
consumed by ``hypotheses.stream_first_valid`` (F10 per micro-batch).
"""
