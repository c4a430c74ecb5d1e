"""Column functions: text features, cleaning, scores and bands."""
