"""Column functions on identifiers, time and coordinates."""
