"""Column builders: series primitives, scans and the formula language."""
