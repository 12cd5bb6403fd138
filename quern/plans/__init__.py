"""Query catalogue and pipeline plans."""
