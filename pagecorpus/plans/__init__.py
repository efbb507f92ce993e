"""Jobs put together from the operators."""
