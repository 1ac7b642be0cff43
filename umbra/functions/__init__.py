"""functions of umbra."""
