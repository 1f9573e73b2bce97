"""Archives that are still arriving."""
