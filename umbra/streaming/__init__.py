"""streaming of umbra."""
