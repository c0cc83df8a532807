"""Plans: whole jobs made of operators, and the registered queries."""
