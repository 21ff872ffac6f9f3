"""Column functions: text, dates, numbers, bands."""
