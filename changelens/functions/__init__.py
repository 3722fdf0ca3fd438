"""Column functions; those that only a lexer can express are Arrow UDFs."""
