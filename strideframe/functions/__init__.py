"""Column functions: geometry, confidence, scoring. All of them are built-in expressions."""
