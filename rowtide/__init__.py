"""Analytics over ordered, typed tables, as Spark DataFrame plans."""
