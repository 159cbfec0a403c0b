"""Reading datasets and reference graphs."""
