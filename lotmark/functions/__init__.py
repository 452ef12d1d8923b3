"""Column functions: text, money, package codes, states."""
