"""Security and privacy analytics over app inventories, traffic and text, as Spark DataFrame operators."""
