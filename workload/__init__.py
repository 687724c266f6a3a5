"""The operators bound to the supplied tables, each with the SQL that states its result."""
