"""A seeded generator of the star schema's tables, as column expressions over hashed uniforms."""
