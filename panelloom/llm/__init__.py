"""Training-data operators: each module holds one operator and is independent of the analytics library around it."""
