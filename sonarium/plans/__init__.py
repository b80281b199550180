"""Named queries over the tables of a folder, and their SQL."""
