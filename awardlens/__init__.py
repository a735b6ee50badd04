"""Contract-award review engine on Spark."""
