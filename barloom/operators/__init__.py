"""DataFrame operators over numbered bars."""
