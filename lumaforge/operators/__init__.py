"""DataFrame -> DataFrame operators over the asset catalog and the pixel table."""
