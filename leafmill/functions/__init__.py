"""Column rules: pure Catalyst expressions."""
