"""Plan builders shared by the operators: feature paths, global order, exact quantiles."""
