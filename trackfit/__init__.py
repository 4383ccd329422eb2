"""trackfit: mathematical structure in ordered data, expressed as Spark plans."""
