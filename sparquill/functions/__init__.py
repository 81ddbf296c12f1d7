"""Small functions on values: JSON text, identifiers, defaults."""
