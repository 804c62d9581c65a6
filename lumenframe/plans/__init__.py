"""Named queries over the stored tables, each with an independent SQL form."""
