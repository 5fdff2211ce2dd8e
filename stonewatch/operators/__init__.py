"""DataFrame operators, one module per area."""
