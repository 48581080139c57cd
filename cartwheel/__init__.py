"""cartwheel: commerce analytics (catalogue, carts, checkout, orders, sellers,
data quality) expressed as Spark DataFrame jobs over all keys at once."""

__version__ = "0.1.0"
