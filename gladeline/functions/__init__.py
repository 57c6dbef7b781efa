"""Column functions: numbers, labels, GeoJSON."""
