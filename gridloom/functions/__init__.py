"""Part of gridloom."""
