"""dupescope.plans."""
