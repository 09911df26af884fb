"""Reading and writing products, taxonomies, mappings and frequency tables."""
