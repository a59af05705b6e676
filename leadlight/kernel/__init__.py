"""Structure kernels: molecules in, values out."""
