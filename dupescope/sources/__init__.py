"""dupescope.sources."""
