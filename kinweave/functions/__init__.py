"""Column functions of the linkage engine."""
