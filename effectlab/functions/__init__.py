"""Column functions: built-in expressions that stay inside generated code."""
