"""Event-time windows that run alike on batches and streams."""
