"""Event-feed analytics expressed as Spark DataFrame transformations."""
