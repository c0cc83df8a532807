"""Column functions: expressions that Catalyst compiles, and Arrow UDFs where logic is sequential."""
