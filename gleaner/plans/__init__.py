"""Query compilation and end-to-end plans."""
