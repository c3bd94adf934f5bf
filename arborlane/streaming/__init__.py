"""Job control as tables and streams."""
