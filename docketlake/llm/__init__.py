"""Training-data operators: ten corpus operations and their queries."""
