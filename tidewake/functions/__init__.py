"""Column functions: geodesy, text, time and money."""
