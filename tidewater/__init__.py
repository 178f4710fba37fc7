"""Live, filtered views of keyed tables on Spark."""
