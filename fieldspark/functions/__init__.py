"""Column functions: complex arithmetic, tapers, transfer-function physics."""
