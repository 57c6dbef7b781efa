"""Raster, footprint, zonal, clustering and proximity operators."""
