"""Part of tickloom."""
