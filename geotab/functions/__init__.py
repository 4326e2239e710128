"""Column functions: orientation, geometry, names."""
