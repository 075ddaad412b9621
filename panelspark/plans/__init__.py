"""plans of the panel engine."""
