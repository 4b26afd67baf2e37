"""Training-data operators (the ten dealt ones).  Nothing else in the library imports
this subpackage; ``queries.py`` registers its queries and their SQL."""
