"""Analytics operators over pixel, point, cube and prediction tables."""
