"""strataspan: bitemporal property-graph analytics as Spark DataFrame plans."""
