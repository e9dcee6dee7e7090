"""Where files, diffs and commits come from."""
