"""Analytics over large ordered collections of strings, on Spark."""
