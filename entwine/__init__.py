"""Entity resolution and matching analytics as Spark plans."""
