"""dupescope.operators."""
