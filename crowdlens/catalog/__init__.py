"""Every operator as a named query over the test tables, with the same question in SQL where SQL can ask it."""
