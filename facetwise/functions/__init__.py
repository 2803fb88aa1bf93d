"""Column builders: geometry of triangles and surfaces, metrics and scores."""
