"""Event-time extension."""
