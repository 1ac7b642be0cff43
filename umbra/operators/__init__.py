"""operators of umbra."""
