"""Column-level building blocks: metric definitions, formats, exact quantiles."""
