"""Column functions: geometry, masks, text mark-up, arrays."""
