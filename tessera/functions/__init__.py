"""Column functions: cleaning, casting and outliers."""
