"""dupescope.streaming."""
