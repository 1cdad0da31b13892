"""lotwise.functions."""
