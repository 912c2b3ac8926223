"""DataFrame operators, from link health to clusters and folder trees."""
