"""Relational operators on pixels, palettes, rings, candidates and documents."""
