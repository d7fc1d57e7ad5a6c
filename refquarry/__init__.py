"""refquarry: mining references to research data in publication text with PySpark."""
