"""Graph and partition sources, and result sinks."""
