"""Writers: cleaned tables, result sections, history, extracted data."""
