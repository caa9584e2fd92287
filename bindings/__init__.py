"""Binds the library to the given test tables: sheets, registered queries and their SQL."""
