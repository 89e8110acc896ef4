"""Readers: images, procedural rasters, rings from events, text and JSON helpers."""
