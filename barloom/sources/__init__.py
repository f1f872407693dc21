"""Sources and sinks of bar tables."""
