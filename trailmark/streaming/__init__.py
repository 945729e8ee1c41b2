"""Live sessions."""
