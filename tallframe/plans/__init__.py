"""Named queries over the tables of a folder, each with SQL for the same result where SQL can express it."""
