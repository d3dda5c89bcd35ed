"""Training-data operators over document and vector tables."""
