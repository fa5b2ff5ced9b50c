"""Readers and writers: table sets, the JSON event log, result sinks."""

from touchline.sources.tables import load_tables, read_table, cached, write_result  # noqa: F401
from touchline.sources.events import read_events, EVENT_FIELDS  # noqa: F401
