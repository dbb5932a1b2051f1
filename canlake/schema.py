"""Tables of the data model and the constants of its semantics."""

from __future__ import annotations

FRAMES = "run_id string, seq long, t_us long, channel int, id long, extended boolean, dlc int, data binary, dir string"
BUSES = "channel int, bus_name string, dbc_path string"
MESSAGES = "channel int, id long, extended boolean, name string, dlc int, transmitter string"
SIGNALS = (
    "channel int, id long, ord int, signal string, start_bit int, size int, big_endian boolean, signed boolean, "
    "factor double, offset double, min double, max double, unit string, receivers array<string>"
)
NODES = "channel int, ord int, node string"
SELECTION = "view string, ord int, channel int, id long, signal string, visible boolean"

KEY = ["run_id", "channel", "id"]

# Fixed values.
#: Frames kept by a trace, frames shown by a trace view, samples kept for a signal.
TRACE_LIMIT, VIEW_LIMIT, HISTORY_LIMIT = 50_000, 1_000, 4_000
#: Least gap between two kept samples of a signal, in microseconds.
SAMPLE_GAP_US = 50_000
#: Smoothing: share of the old value and of the new one.
OLD, NEW = 0.9, 0.1
#: Bits of a frame without its payload, and the bit rate that load is measured against.
STANDARD_BITS, EXTENDED_BITS, BIT_RATE = 47, 67, 500_000
#: The name that stands for no node.
NO_NODE = "Vector__XXX"
