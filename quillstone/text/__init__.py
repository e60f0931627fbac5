"""Document operators: layout, sections, boilerplate, chunks, quotes, recurrence, briefs, search."""
