"""Column builders: text rules, sentence packing, vector arithmetic."""
