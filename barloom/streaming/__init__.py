"""The bar operators on streams."""
