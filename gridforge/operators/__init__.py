"""Operators on cell-by-epoch frames and catalogues."""
