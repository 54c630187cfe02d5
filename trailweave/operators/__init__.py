"""The k-path kernel, exact paths, and partition layout analytics."""
