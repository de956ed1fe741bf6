"""Column functions: type detection and templates."""
