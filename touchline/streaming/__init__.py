"""Incremental versions of the event-log marts (Structured Streaming)."""

from touchline.streaming.orders_stream import (  # noqa: F401
    orders_per_month_store_stream, start_orders_per_month_store,
)
