"""The query front end: condition language, query description, plans."""
