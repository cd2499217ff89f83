"""Column functions: parsing, time bases, interpolation, geometry."""
