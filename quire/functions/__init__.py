"""Column functions: geometry, text, fonts, section and reference patterns."""
