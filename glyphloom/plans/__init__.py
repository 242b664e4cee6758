"""Choice of a physical form, and registered queries."""
