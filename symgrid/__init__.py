"""Code-map and graph-shaped analytics as DataFrame operators."""
