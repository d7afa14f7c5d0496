"""Training-data operators. Nothing outside this subpackage imports it; ``queries`` registers its queries and SQL."""
