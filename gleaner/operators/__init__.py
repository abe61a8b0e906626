"""Relational building blocks: segmentation, scoring, recall, packing, accounting."""
