"""Training-data operators; nothing else in evidex imports this package."""
