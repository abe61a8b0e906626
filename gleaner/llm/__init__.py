"""Training-data operators: ten components and the corpus pipeline's stages.

Nothing else in the library imports this subpackage.
"""
