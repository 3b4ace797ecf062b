"""Training-data operators: cleaning, de-duplication, tokens, archives and chat data."""
