"""Operations on rasters, masks and shapes as DataFrame transforms."""
