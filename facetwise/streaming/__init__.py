"""Run records as a stream."""
