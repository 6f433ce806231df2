"""Column functions on text, dates and URLs."""
