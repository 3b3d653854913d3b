"""Where rasters, masks, triangles and rectangles come from, and where they go."""
