"""Sources, sinks and the transfer between them."""
