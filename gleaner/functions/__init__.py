"""Column expressions shared by every operator; no UDFs."""
