"""Where files, changes and settings come from."""
