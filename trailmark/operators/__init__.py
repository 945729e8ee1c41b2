"""Operators over check-ins, sessions, places and decision states."""
