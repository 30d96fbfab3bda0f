"""entweave: entity lookup and table linking as Spark DataFrame transformations."""
