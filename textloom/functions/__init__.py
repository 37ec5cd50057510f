"""Column functions: vector measures and algebra, text, tokenisers, alignment."""
