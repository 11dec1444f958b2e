"""Table readers, sinks and the derived input views."""
