"""The domain operators, one module per field."""
