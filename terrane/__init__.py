"""terrane: patent-landscape analytics expressed as Spark plans."""
