"""Changes and events as they come, on Structured Streaming."""
