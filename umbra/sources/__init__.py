"""sources of umbra."""
