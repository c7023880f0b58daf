"""Live ledgers."""
