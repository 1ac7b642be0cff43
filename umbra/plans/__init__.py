"""plans of umbra."""
