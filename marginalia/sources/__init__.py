"""Sources, sinks and the session."""
