"""Column builders: pure functions returning ``Column`` expressions."""
